"""Alignment of two tokenizers against a plain loop over whole texts, encoded by the libraries."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from .conftest import prose

import public_tokenizers
import sentencepiece
import tokenizers
from tablecare.llm import alignment

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def groups_of(text, libraries):
    a, b = libraries
    letters = alignment.byte_letters()
    spaced = (" " + text).encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or b"".join(x for _, x in left) != spaced or b"".join(x for _, x in right) != spaced:
        return []
    found, ids, ends = [], ([], []), [0, 0]
    queues = [list(left), list(right)]
    while queues[0] or queues[1]:
        side = 0 if ends[0] <= ends[1] else 1
        i, data = queues[side].pop(0)
        ids[side].append(i)
        ends[side] += len(data)
        if ends[0] == ends[1]:
            found.append(ids)
            ids = ([], [])
    return found


def expected(rows, libraries):
    parted = [(i, groups_of(t or "", libraries)) for i, t in rows]
    counts = Counter()
    for _, groups in parted:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for i, groups in parted:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        sizes = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links))
        measures = (sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links))
        out.append((i, *sizes, *measures, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(df):
    names = [c.split()[0] for c in alignment.RESULT.split(", ")]
    return sorted((tuple(r[c] for c in names) for r in alignment.align(df, JSON, MODEL).collect()), key=str)


BLANKS = [
    "a  b", " a b", "a b ", "a\n b", "a\n \n b", "a \n b", "a\t b\t\tc", "a   b    c", "x  y", "x\x1c y\x1d\x1e z", "x\x85 y", "  q  ", "a▁ b", "▁", "it's 'll  's", "... ,, !? a.b",
    "<s> a </s> <unk> <0x41> <|endoftext|> b<|endoftext|>", "ﬁ Å é ＡＢ", "한국 ไทย \U0001f469‍\U0001f469‍\U0001f467", "a\x00 b", "\r\n x \r\n", "1234567 89 0.5 ",
]


def test_odd_texts(frame, odd, libraries):
    rows = [r for r in odd if len(r[1] or "") < 5000] + [(100 + k, t) for k, t in enumerate(BLANKS)] * 2 + [(300, prose(8, 400))]
    assert found(frame(rows)) == expected(rows, libraries)


def test_long_texts(frame, libraries):
    rows = [(1, prose(3, 6000)), (2, "x" * 4000 + " y"), (3, " ".join("ab" for _ in range(3000))), (4, "\n" * 500 + "a" + " " * 700)]
    assert found(frame(rows)) == expected(rows, libraries)


def test_blocks_and_memory_change_nothing(frame, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    rows = [(k, prose(k % 17, 30 + k % 5)) for k in range(60)]
    assert found(frame(rows)) == expected(rows, libraries)


def test_wide_groups_count_by_distinct_ids(frame, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 2)
    rows = [(k, prose(k, 40) + " \u0e44\u0e17\u0e22 12345") for k in range(20)]
    assert found(frame(rows)) == expected(rows, libraries)


def test_empty_table(frame):
    assert found(frame([])) == [] and found(frame([(1, None), (1, ""), (None, "")])) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2 + [(None, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_documents(spark, libraries):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == expected(rows, libraries)


def blocks(texts, monkeypatch, one):
    """What the mapper gives for one batch of distinct texts, in this process."""

    class Task:
        get = staticmethod(lambda: Task())
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(alignment, "TaskContext", Task)
    monkeypatch.setattr(alignment, "aligner", lambda *_: one)
    keys = [k.to_bytes(alignment.KEY, "big") for k in range(len(texts))]
    batch = pa.record_batch([pa.array(keys), pa.array(texts), pa.array(list(range(1, len(texts) + 1)))], ["key", "text", "n"])
    return [b.to_pylist()[0] for b in alignment._pack(JSON, MODEL)(iter([batch]))]


def test_words_of_a_block_are_encoded_once(monkeypatch):
    class Counting:
        """A tokenizer that remembers how many characters it was given."""

        def __init__(self, of):
            self.of, self.given = of, 0

        def __getattr__(self, name):
            return getattr(self.of, name)

        def encode(self, texts, **options):
            self.given += sum(map(len, texts))
            return self.of.encode(texts, **options)

        def encode_batch_fast(self, texts, **options):
            self.given += sum(map(len, texts))
            return self.of.encode_batch_fast(texts, **options)

    one = alignment.Aligner(JSON, MODEL)
    one.a, one.b = Counting(one.a), Counting(one.b)
    texts = [prose(k, 300) for k in range(50)]
    assert len(blocks(texts, monkeypatch, one)) == 1
    distinct = sum(len(w) + 1 for w in {w for t in texts for w in t.split()})
    assert one.a.given <= distinct and one.b.given <= distinct


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 100, "BATCH": 7, "RUN": 1, "LINKS": 1}, {"BATCH": 20, "RUN": 3, "LINKS": 40, "WIDE": 2}])
def test_words_give_what_texts_give(limits, libraries, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    spaces = [" ", "\n", "  ", " \n", "\n ", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u180e", "\u2003", "\u3000", "\u200b", "\x00", "\x7f", "."]
    texts = list(dict.fromkeys([x + s + y for s in spaces for x, y in (("a", "b"), ("é", "漢"), ("", "a b"), ("b a", ""), ("c a ", "\nb"))] + BLANKS))
    expected_counts, found, counts = Counter(), {}, Counter()
    for block in blocks(texts, monkeypatch, alignment.Aligner(JSON, MODEL)):
        read = lambda c, t="<i8", block=block: np.frombuffer(block[c], t).tolist()
        pairs, ends, places, times = read("pairs"), read("pair_ends"), read("places", "<u4"), read("times")
        counts.update(dict(zip(pairs, read("documents"), strict=True)))
        for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            links = {pairs[p]: n for p, n in zip(places[s:e], times[s:e], strict=True)}
            found[int.from_bytes(block["keys"][32 * k : 32 * k + 32], "big")] = (read("numbers")[4 * k : 4 * k + 4], block["digests"][32 * k : 32 * k + 32], links)
    for k, text in enumerate(texts):
        groups = groups_of(text, libraries)
        assert (k in found) == bool(groups), repr(text)
        if groups:
            links = Counter(x << 32 | y for a, b in groups for x in a for y in b)
            written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            sizes = [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values())]
            assert found[k] == (sizes, hashlib.sha256(written.encode()).digest(), links), repr(text)
            expected_counts.update(dict.fromkeys(links, k + 1))
    assert counts == expected_counts


def test_other_models_keep_whole_texts(tmp_path):
    assert alignment.words_apart(JSON, MODEL)
    other = tmp_path / "other.json"
    with open(JSON, encoding="utf-8") as f:
        content = f.read()
    other.write_text(content.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'), encoding="utf-8")
    assert other.read_text(encoding="utf-8") != content and not alignment.words_apart(str(other), MODEL)
    words, ends = alignment.words_of(pa.array(["a b", "c\nd "]), False)
    assert words.to_pylist() == [" a b", " c\nd "] and ends.tolist() == [1, 2]
    words, ends = alignment.words_of(pa.array(["a  b c", "c\nd "]), True)
    assert words.to_pylist() == [" a", "  b", " c", " c", "\nd "] and ends.tolist() == [3, 5]
