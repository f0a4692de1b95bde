"""Token files, token counts and SentencePiece coding against the libraries."""

import os
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablecare.llm import pieces, token_counts, token_files
from tablecare.llm.bpe import PieceModel

from .conftest import prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def order(row):
    return (row[0] is not None, row[0] or 0)


def test_token_files(spark, frame, odd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(frame(odd), path, WORD)
    library = Tokenizer.from_file(WORD)
    want = {}
    for i, t in odd:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    rows = sorted(token_files.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in sorted(odd, key=order)]
    start = 0
    for r in rows:
        ids = want[r["doc_id"]][0]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    kept = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, path, 6, 9).collect()}
    assert set(kept) == {6, 7, 8, 9} and kept[9] == want[9][0]
    index = token_files.read_index(spark, path)
    assert "ids" not in index.columns and index.count() == len(odd)


def test_token_file_layout(spark, frame, tmp_path):
    path = tmp_path / "tokens"
    token_files.write_token_files(frame([(i, prose(i, 50)) for i in range(2000)]), str(path), WORD, page_rows=100)
    for f in path.glob("*.parquet"):
        columns = {c.path_in_schema: c for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in (g.column(k) for k in range(g.num_columns))}
        ids = next(c for n, c in columns.items() if n.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings)
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert ids.has_offset_index and columns["doc_id"].has_column_index


def test_no_documents(spark, frame, tmp_path):
    token_files.write_token_files(frame([]), str(tmp_path / "t"), WORD)
    assert token_files.digests(spark, str(tmp_path / "t")).isEmpty()
    assert token_counts.count_tokens(frame([]), WORD).isEmpty()
    assert pieces.round_trip(frame([]), PIECE).isEmpty()
    assert pieces.decode(pieces.encode(frame([]), PIECE), PIECE).isEmpty()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(frame, odd, name):
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(library.encode(t))
    else:
        library = Tokenizer.from_file(P.path(name))
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = token_counts.count_tokens(frame(odd), P.path(name), limit=100).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows), key=str)
    want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t in odd), key=str)
    assert got == want


def test_memory_of_words_may_be_emptied(monkeypatch):
    texts = [prose(i, 200) + " Word, end." for i in range(30)]
    encoder, counter = token_files.Encoder(WORD), token_counts.JsonCounter(WORD)
    whole = [encoder.ids(t) for t in texts]
    encoder.words.most = counter.words.most = counter.pieces.most = 5
    assert [encoder.ids(t) for t in texts] == whole
    assert [counter.count(t) for t in texts] == [len(w) // 4 for w in whole]


def test_pieces_and_spans(spark, frame, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = pieces.encode(frame(odd), PIECE)
    texts = {i: t or "" for i, t in odd}
    for r in encoded.collect():
        text = texts[r["doc_id"]]
        assert r["ids"] == library.encode(text)
        data, proto = text.encode(), library.encode(text, return_type="proto")
        spans = [data[a:b].decode("utf-8", "replace") for a, b in zip(r["starts"], r["ends"])]
        assert spans == [p.surface for p in proto.pieces]
        assert not r["ends"] or r["ends"][-1] == len(data)
    for r in pieces.decode(encoded, PIECE).collect():
        assert r["text"] == library.decode(library.encode(texts[r["doc_id"]]))


def test_decoding_of_any_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    decoder = pieces.coder(PIECE)[1]
    random = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        for _ in range(100):
            ids = random.integers(0, 400 if n % 2 else 32000, n)
            assert decoder.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_by_a_compiled_map(rule):
    """Normalised text and the source place of each character, with a map that joins, splits and drops characters."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = object.__new__(PieceModel)
    spec = dict(pieces_fields(library.serialized_model_proto()))
    model.charsmap, model.dummy_prefix, model.remove_extra, model.escape = spec.get(2, b""), True, True, True
    ours = pieces.Normaliser(model)
    for text in ["", "  ", "  ＡＢＣ　①  ㍿x ", "ｶﾞ é́ ﬁ Å", "a​b\tc", "İSTANBUL ß", "x" * 50 + "  y"]:
        want, offsets = library.normalize(text, with_offsets=True)
        got, source = ours.aligned(text)
        assert got == want
        starts = np.cumsum([0] + [len(c.encode()) for c in got])[:-1]
        places = np.cumsum([0] + [len(c.encode()) for c in text])
        assert [int(source[s]) for s in starts] == [int(places[o]) for o in offsets[: len(got)]]


def pieces_fields(data):
    from tablecare.llm.bpe import NORMALIZER, fields

    return fields(dict(fields(data))[NORMALIZER])
