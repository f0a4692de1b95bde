"""Alignment of two tokenizers' tokens by the bytes they cover, with counts over the corpus.

Texts are shuffled whole, so that equal ones meet and each distinct text is
encoded and aligned once, with its number of documents.

Distinct texts are packed into blocks.  A block's texts are cut into words where
no token of either tokenizer reaches across; each distinct word is encoded and
aligned once.  A block has a dictionary of its linked id pairs and refers to it
by place.  Pair counts are added up from the dictionaries, weighted with the
texts' documents; each block gets the counts of its own pairs back, and its
texts' measures are joined to the document ids.

A group ends where a token of both ends; all tokens of a group are linked with
each other.  A pair's count is the number of documents that link it.

Defined cases: a null or empty text, or one whose tokens' bytes don't give the
text back in either tokenizer, has no tokens: zeros and an empty digest.  Every
row is a document, also rows with equal or without ids; each keeps its row.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.bpe import BLANK, PieceModel
from tablecare.llm.texts import id_and_text, raw, slices
from tablecare.sources.session import cut_lineage

#: Text of a block; its words, its dictionary of pairs and the references to it are held by one task.
BLOCK_BYTES = 8 << 20
#: Distinct words that are aligned at a time, and those of them that the first tokenizer gets as one text.
BATCH, RUN = 1 << 15, 256
#: Links of words that are added up by text at a time, those of a text together.
LINKS = 1 << 19
#: Links from which a group's pairs are counted by distinct ids.
WIDE = 4096

BLOCKS = "block long, keys binary, numbers binary, digests binary, pair_ends binary, places binary, times binary, pairs binary, documents binary"
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Bytes of a text's key.
KEY = 32
#: White space of more than one byte, each as the number of its last two or three bytes.
WIDE_BLANKS = [int.from_bytes(c.encode()) for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next unused from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


def words_apart(json_path: str, model_path: str) -> bool:
    """Whether no token of either tokenizer reaches over the start of white space, and none has bytes that its text hasn't.

    Then a text's tokens are those of its words, and a text is given back if all its words are.
    """
    with open(json_path, encoding="utf-8") as f:
        content = json.load(f)
    before, model = content.get("pre_tokenizer") or {}, content["model"]
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or content.get("normalizer") or content.get("truncation"):
        return False
    if model["type"] != "BPE" or model.get("dropout") or not byte_letters().keys() <= model["vocab"].keys() or not all(t["special"] for t in content.get("added_tokens") or []):
        return False
    try:
        with open(model_path, "rb") as f:
            m = PieceModel(f.read())
    except ValueError:
        return False
    if m.charsmap or m.remove_extra or not (m.escape and m.dummy_prefix and m.byte_fallback) or len(m.byte_ids) < 256:
        return False
    return not any("\n" in (x, y) or y == BLANK != x for x, y in m.adjacent)


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before a place is none of white space or control; the last byte stands before the first."""
    last = data[at - 1]
    solid = (last > 0x20) & (last < 0x7F)
    high = np.flatnonzero(last >= 0x80)
    two, three = (sum(data[at[high] - k].astype(np.int64) << 8 * (k - 1) for k in range(1, n + 1)) for n in (2, 3))
    solid[high] = ~(np.isin(two, WIDE_BLANKS) | np.isin(three, WIDE_BLANKS))
    return solid


def words_of(column: pa.Array, apart: bool) -> tuple[pa.Array, np.ndarray]:
    """The texts with a blank before each, cut into words, and the end of each text's words.

    A word begins with a blank or line end after something else than white
    space; a text that ends in one keeps it in its last word.
    """
    data, ends = raw(column)
    data, ends = np.insert(data, ends[:-1], 0x20), ends + np.arange(len(ends))
    starts = ends[:-1]
    new = np.zeros(len(data), bool)
    if apart:
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        new[at[_solid(data, at)]] = True
        new[ends[1:] - 1] = False
    new[starts] = True
    first = np.flatnonzero(new)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data))
    return words, np.append(np.searchsorted(first, starts[1:]), len(first))


class Aligner:
    """Both tokenizers, and the bytes and decimal numbers of their ids."""

    def __init__(self, json_path: str, model_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.a = tokenizers.Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.bytes = [np.array(t, object) for t in (self.a_bytes, self.b_bytes)]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        # a decimal id and what follows it: further ids of its group, or the group's other half or end
        self.written = [np.array([f"{i}{mark}" for i in range(len(t)) for mark in f",{end}"], object) for t, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]
        self.apart = words_apart(json_path, model_path)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both, how many ids each word has, and the ids end to end; the second puts a blank before a word itself, which isn't there before a line end."""
        data, ends = raw(words)
        cuts = ends if not self.apart else ends[(np.arange(len(ends)) % RUN == 0) | ~_solid(data, ends) | (ends == ends[-1])]
        whole = data.tobytes()
        a = _flat([e.ids for e in self.a.encode_batch_fast([whole[x:y].decode() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], add_special_tokens=False)])
        if self.apart:
            a = np.diff(np.searchsorted(np.cumsum(self.sizes[0][a[1]]), ends, side="right")), a[1]
        texts = words.to_pylist()
        b = self.b.encode([w[1:] if w[0] == " " else w for w in texts], num_threads=1)
        return [a, _flat([ids if w[0] == " " else ids[1:] for w, ids in zip(texts, b, strict=True)])]

    def align(self, words: pa.Array) -> tuple[np.ndarray, Aligned | None]:
        """Which words both tokenizers give back, and the alignment of those."""
        sides, (data, ends) = self.encode(words), raw(words)
        same = self._same(0, *sides[0], data, ends) & self._same(1, *sides[1], data, ends)
        if not same.all():
            sides = [(counts[same], ids[np.repeat(same, counts)]) for counts, ids in sides]
        return np.flatnonzero(same), Aligned(self, sides) if same.any() else None

    def _same(self, side: int, counts: np.ndarray, ids: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words' tokens have the words' bytes."""
        joined = np.frombuffer(b"".join(self.bytes[side][ids].tolist()), np.uint8)
        total, last, sizes = np.append(0, np.cumsum(self.sizes[side][ids])), np.cumsum(counts), np.diff(ends)
        found = total[last] - total[last - counts]
        same = found == sizes
        if not same.all():
            joined, data = joined[np.repeat(same, found)], data[np.repeat(same, sizes)]
        if (joined != data).any():
            same[np.repeat(np.flatnonzero(same), sizes[same])[joined != data]] = False
        return same


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists' lengths, and their values end to end."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return counts, np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))


class Aligned:
    """Tokens of several words of equal bytes in both tokenizers, cut into groups where both end one."""

    def __init__(self, by: Aligner, sides: list[tuple[np.ndarray, np.ndarray]]):
        self.by = by
        counts, self.ids = zip(*sides, strict=True)
        self.bounds = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        ends = [np.cumsum(size[i]) for size, i in zip(by.sizes, self.ids, strict=True)]
        both = np.zeros(int(ends[0][-1]) + 1, bool)
        both[ends[0]] = True
        cuts = ends[1][both[ends[1]]]
        self.group = [np.searchsorted(cuts, e) for e in ends]
        self.members = [np.bincount(g, minlength=len(cuts)) for g in self.group]
        self.first = [np.cumsum(m) - m for m in self.members]
        self.word_of_group = np.searchsorted(self.bounds[0][1:], self.first[0], side="right")

    def numbers(self) -> np.ndarray:
        """A row a word: ids of A, ids of B, groups, links."""
        words = len(self.bounds[0]) - 1
        groups = np.bincount(self.word_of_group, minlength=words)
        links = np.zeros(words, np.int64)
        np.add.at(links, self.word_of_group, self.members[0] * self.members[1])
        return np.stack([np.diff(self.bounds[0]), np.diff(self.bounds[1]), groups, links], axis=1)

    def texts(self) -> list[str]:
        """Each word's groups written out, each with its end."""
        (a, b), (ga, gb) = self.ids, self.group
        at_a, at_b = np.arange(len(a)) + self.first[1][ga], np.arange(len(b)) + (self.first[0] + self.members[0])[gb]
        words = np.empty(len(a) + len(b), object)
        words[at_a] = self.by.written[0][2 * a + self._last(0)]
        words[at_b] = self.by.written[1][2 * b + self._last(1)]
        bounds = (self.bounds[0] + self.bounds[1]).tolist()
        words = words.tolist()
        return ["".join(words[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]

    def _last(self, side: int) -> np.ndarray:
        """1 for the last token of a group."""
        group = self.group[side]
        return np.concatenate([group[1:] != group[:-1], [True]]).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, pair a << 32 | b and times of the distinct pairs of each word, in order."""
        sizes = self.members[0] * self.members[1]
        wide = np.flatnonzero(sizes > WIDE)
        (a, b), (ga, _) = self.ids, self.group
        reps = np.where(sizes[ga] > WIDE, 0, self.members[1][ga])
        other = np.repeat(self.first[1][ga] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        words, pairs = [np.repeat(self.word_of_group[ga], reps)], [np.repeat(a, reps) << 32 | b[other]]
        times = [np.ones(len(other), np.int64)]
        for g in wide:
            (x, m), (y, n) = (np.unique(i[f[g] : f[g] + c[g]], return_counts=True) for i, f, c in zip(self.ids, self.first, self.members, strict=True))
            pairs.append((x[:, None] << 32 | y).ravel())
            times.append((m[:, None] * n).ravel())
            words.append(np.full(len(x) * len(y), self.word_of_group[g]))
        words, pairs, times = (np.concatenate(p) for p in (words, pairs, times))
        order = np.lexsort([pairs, words])
        words, pairs, times = words[order], pairs[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (pairs[1:] != pairs[:-1])]))
        return words[new], pairs[new], np.add.reduceat(times, new)


@lru_cache(maxsize=1)
def aligner(json_path: str, model_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(json_path, model_path)


def _pack(json_path: str, model_path: str):
    """Blocks of aligned texts from rows of key, text and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, task, made, held, size = aligner(json_path, model_path), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for piece in slices(batch):
                held.append(piece)
                size += piece.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield from _block(task << 32 | made, one, held)
                    made, held, size = made + 1, [], 0
        if held:
            yield from _block(task << 32 | made, one, held)

    return run


def _block(number: int, one: Aligner, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of the rows whose texts both tokenizers give back, if there are any."""
    rows = pa.Table.from_batches(held)
    words, ends = words_of(rows.column("text").cast(pa.large_string()).combine_chunks(), one.apart)
    found = words.dictionary_encode()
    words, places = found.dictionary, found.indices.to_numpy()
    whole, numbers, texts, links = np.zeros(len(words), bool), np.zeros((len(words), len(MEASURES)), np.int64), np.full(len(words), "", object), []
    start = 0
    for some in (part for at in range(0, len(words), BATCH) for part in slices(pa.record_batch([words.slice(at, BATCH)], ["word"]), "word")):
        kept, aligned = one.align(some.column("word"))
        if aligned is not None:
            at = start + kept
            whole[at], numbers[at], texts[at] = True, aligned.numbers(), aligned.texts()
            of, *rest = aligned.links()
            links.append((at[of], *rest))
        start += some.num_rows
    good = np.logical_and.reduceat(whole[places], np.concatenate([[0], ends[:-1]]))
    if not good.any():
        return
    counts = np.diff(ends, prepend=0)
    places, counts, rows = places[np.repeat(good, counts)], counts[good], rows.select(["key", "n"]).filter(pa.array(good))
    ends = np.cumsum(counts)
    totals = np.stack([np.add.reduceat(n[places], ends - counts) for n in numbers.T], axis=1)
    digests = [hashlib.sha256("".join(texts[places[s:e]].tolist())[:-1].encode()).digest() for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    sizes = np.zeros(len(words), np.int64)
    del found, words, numbers, texts  # several workers share an executor's memory
    of, pairs, times = (np.concatenate(p) for p in zip(*links, strict=True))
    np.add.at(sizes, of, 1)
    known, refers = np.unique(pairs, return_inverse=True)
    del links, of, pairs
    counts, places, times = _links(counts, places, sizes, refers, times)
    used = np.zeros(len(known), bool)  # by texts that have all their words
    used[places] = True
    known, places = known[used], (np.cumsum(used) - 1)[places]
    weights = np.zeros(len(known), np.int64)
    np.add.at(weights, places, np.repeat(rows.column("n").to_numpy(), counts))
    data = [
        b"".join(rows.column("key").to_pylist()), totals.astype("<i8").tobytes(), b"".join(digests), np.cumsum(counts).astype("<i8").tobytes(),
        places.astype("<u4").tobytes(), times.astype("<i8").tobytes(), known.astype("<i8").tobytes(), weights.astype("<i8").tobytes(),
    ]
    yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([d], pa.binary()) for d in data)], [c.split()[0] for c in BLOCKS.split(", ")])


def _links(counts: np.ndarray, words: np.ndarray, sizes: np.ndarray, places: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct pairs each text has, their places and times, from each text's words and how many of the links each word has."""
    has = np.repeat(np.arange(len(counts)) << 32, counts) | words
    has.sort()
    new = np.flatnonzero(np.concatenate([[True], has[1:] != has[:-1]]))
    often, has = np.diff(new, append=len(has)), has[new]
    texts, words = has >> 32, has & 0xFFFFFFFF
    first, reps = (np.cumsum(sizes) - sizes)[words], sizes[words]
    starts = np.flatnonzero(np.diff(texts, prepend=-1))
    before = (np.cumsum(reps) - reps)[starts]
    cuts = [*starts[np.flatnonzero(np.diff(before // LINKS, prepend=-1))].tolist(), len(texts)]
    found = []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        r = reps[s:e]
        link = np.repeat(first[s:e] - (np.cumsum(r) - r), r) + np.arange(r.sum())
        has, sums = _summed(np.repeat(texts[s:e], r) << 32 | places[link], np.repeat(often[s:e], r) * times[link])
        found.append((has >> 32, has & 0xFFFFFFFF, sums))
    texts, places, times = (np.concatenate(p) for p in zip(*found, strict=True))
    return np.bincount(texts), places, times


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the times of each added up."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(times, new)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of each block: the documents of the block that link it."""
    for batch in batches:
        for block, pairs, documents in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "documents")), strict=True):
            found = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), block)), pa.array(np.frombuffer(documents, "<i8"))], ["pair", "block", "n"])


def _measures(block: pa.Table, counts: pa.Table) -> pa.Table:
    """A row for each text of a block, given count and rank of the block's pairs."""
    row = block.to_pylist()[0]
    pairs = counts.column("pair").to_numpy()
    order = np.argsort(pairs)
    known = np.frombuffer(row["pairs"], "<i8")
    if len(order) != len(known) or (pairs[order] != known).any():
        raise ValueError("a block's pairs and their counts differ")
    count, best = counts.column("count").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    ends = np.frombuffer(row["pair_ends"], "<i8")
    places, times = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["times"], "<i8")
    starts = np.concatenate([[0], ends[:-1]])
    sums = np.add.reduceat(times * count[places], starts)
    bests = np.add.reduceat(times * best[places], starts)
    totals = np.frombuffer(row["numbers"], "<i8").reshape(-1, 4)
    keys = [row["keys"][i : i + KEY] for i in range(0, len(row["keys"]), KEY)]
    digests = [row["digests"][i : i + 32].hex() for i in range(0, len(row["digests"]), 32)]
    columns = {"key": pa.array(keys, pa.binary())} | {c: pa.array(totals[:, k]) for k, c in enumerate(MEASURES)}
    return pa.table(columns | {"n_best": pa.array(bests), "count_sum": pa.array(sums), "groups_sha256": pa.array(digests)})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (a << 32 | b), count (documents that link it) and whether that is its A id's highest."""
    counts = blocks.select("block", "pairs", "documents").mapInArrow(_pairs, "pair long, block long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", first).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned_blocks(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """Blocks of the distinct texts of rows with doc_id and text."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    keyed = texts.select(_key(), "text", "n")
    return keyed.mapInArrow(_pack(json_path, model_path), BLOCKS)


def _key():
    return F.unhex(F.sha2("text", 256)).alias("key")


def align(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every document: tokens, groups, links, links of the A id's highest count, counts added up, digest of the groups."""
    rows = id_and_text(docs, id_col, text_col)
    blocks = cut_lineage(aligned_blocks(rows, json_path, model_path))
    counts = cut_lineage(pair_counts(blocks))
    asked = blocks.select("block", "pairs", "documents").mapInArrow(_pairs, "pair long, block long, n long").select("block", "pair").join(counts, "pair")
    kinds = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    measures = cut_lineage(blocks.drop("documents").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_measures, kinds))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*MEASURES, "n_best", "count_sum"]]
    return rows.select("doc_id", _key()).join(measures, "key", "left").select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
