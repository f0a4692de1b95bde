"""Language-model scores by a probabilistic suffix tree over words.

The alphabet is all words and the end of a text.  A context is a run of up to
``DEPTH`` words that occurs at least ``CONTEXT_LEAST`` times in the training
texts; it is a state of the tree if what follows it diverges from what follows
the context without its oldest word: occurrences times Kullback-Leibler
divergence of at least ``DIVERGENCE`` nats.  Continuations seen at least
``NEXT_LEAST`` times are stored.  The least counts are the same at every size,
so the tree grows with the corpus.  All counts are over all training texts.

A state gives P(w | s) = (c(s, w) + l * P(w | shorter state)) / (c(s) + SMOOTH)
for stored continuations' counts c(s, w), with l what the others leave; the
root is the add-0.1 distribution over all words.  A token's probability is that
of the longest state that ends before it.

States and continuations are tables keyed by 64-bit hashes.  Blocks ask for
their own keys, sifted by a bitmap of at most 2^``SIEVE_BITS`` bits, and are
joined with them; what the bitmap lets through in error finds no partner.
Keys travel packed, a list for each block and range of hashes; ranges are as
many as the tokens ask for, and values come back in the order of the keys.
Blocks ask in a few portions, so that the model is dealt out a few times only,
and are scored in parts of those; what is shuffled for one takes no disk beside
the next.
Tables of a depth are removed once the depth after it is written.

The vocabulary isn't bounded, so it stays distributed: texts are packed into
blocks with a dictionary each, and every block is joined with the counts of its
own rare words.  Words are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null doc_id has
the text "" for its check sum; repeated rows count and score each; without
training texts every probability of the base is that of one unseen word; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm.texts import Words, id_and_text, mixed, slices
from tablecare.sources.session import release, work_path

#: Text in a block; its dictionary and packed words are held by one task.
BLOCK_BYTES = 14 << 20
#: Ranges of hashes whose continuations a task hands on at a time.
HANDED = 8
#: Least counts of a context and of a stored continuation.
CONTEXT_LEAST, NEXT_LEAST = 16, 4
DEPTH = 3
DIVERGENCE = 8.0
SMOOTH = 5.0
#: The hash that stands for the end of a text.
END = np.uint64(0x517CC1B727220A95)
#: Words of this share of the tokens are sent to all tasks with their counts, others are joined; no result depends on it.
FREQUENT_SHARE = 2e-5
#: Greatest size of a sieve, and the ranges of hashes in which it is made.
SIEVE_BITS, RANGE_BITS = 27, 8
#: Training tokens to a range of hashes, whose keys are merged by one task; greatest number of ranges as a power of two.
RANGE_TOKENS, MOST_RANGES = 1 << 21, 20

#: Values from which on it pays to sort them before they are looked up.
SORTED_LEAST = 1 << 12

#: Portions in which blocks are scored, and in which they ask, for the disk that this takes; least number of blocks in one.
PORTIONS, ASKING, PORTION_LEAST = 4, 2, 6

BLOCKS = "block long, ids array<long>, held array<boolean>, bounds array<long>, places binary, words binary, counts binary"
ANSWERS = "range long, block long, packed binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row a document."""
    spark = docs.sparkSession
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = id_and_text(docs, id_col, text_col).withColumn("held", checksum % 10 == 0)
    work = _Work(spark)
    work.paths["blocks"] = path = work_path(spark, "blocks")
    rows.mapInArrow(_pack, BLOCKS).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    made, tokens = blocks.agg(F.count("*"), F.sum(F.element_at("bounds", -1))).first()
    bits = min(MOST_RANGES, max(4, ((tokens or 0) // RANGE_TOKENS).bit_length()))

    per_block = blocks.select("words", "counts").mapInArrow(_dictionary(bits), "range long, words binary, n binary")
    counts = work.write("counts", per_block.groupBy("range").applyInArrow(_summed, "word long, c long"))
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    least = max(1.0, FREQUENT_SHARE * total)  # reached by 1 / FREQUENT_SHARE words at most
    frequent = counts.where(F.col("c") >= least).toArrow().sort_by("word")
    model = _model(work, blocks, counts, total, distinct, bits)
    shared = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy().astype(np.int64) for c in ("word", "c")))

    sieve = _sieve(model) if model is not None else None
    known = counts.where(F.col("c") < least).select(F.col("word").alias("key"), F.col("c").cast("double").alias("value"))
    known = (known if model is None else model.unionByName(known)).withColumn("range", F.shiftrightunsigned("key", 64 - bits))
    work.paths["scores"] = out = work_path(spark, "scores")
    for asking in _portions(blocks, made, ASKING):
        asked = asking.select("block", "bounds", "places", "words").mapInArrow(_asked(shared, sieve, bits), ANSWERS)
        answers = work.write("answers", asked.groupBy("range").cogroup(known.groupBy("range")).applyInArrow(_answered, ANSWERS))
        work.drop()
        for span in _spans(asking, made // ASKING, PORTIONS // ASKING):
            part, own = _within(asking.drop("counts"), *span), _within(answers, *span)
            found = part.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_scores(shared, sieve, total, distinct), SCORES)
            found.write.mode("append").parquet(out)
            work.drop()
        work.drop("answers")
    del work.paths["scores"]
    work.drop(*list(work.paths))
    found = spark.read.schema(SCORES).parquet(out)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _portions(blocks: DataFrame, made: int, most: int = PORTIONS) -> list[DataFrame]:
    """The blocks in ranges of their numbers, as tasks wrote them; what is shuffled for one is gone before the next."""
    return [_within(blocks, *span) for span in _spans(blocks, made, most)]


def _spans(blocks: DataFrame, made: int, most: int) -> list[tuple]:
    """Greatest block before each portion and in it, null where there is none."""
    n = max(1, min(most, made // PORTION_LEAST))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = sorted({int(x) for x in blocks.agg(F.percentile("block", shares)).first()[0]}) if n > 1 else []
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def _within(table: DataFrame, low: int | None, high: int | None) -> DataFrame:
    table = table if low is None else table.where(F.col("block") > low)
    return table if high is None else table.where(F.col("block") <= high)


class _Work:
    """Tables in the shared folder that are removed when used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = path = work_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables, and the shuffles of queries that are done."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            if name in self.paths:
                path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(conf).delete(path, True)
        release(self.spark)


def _model(work: _Work, blocks: DataFrame, counts: DataFrame, total: int, distinct: int, bits: int) -> DataFrame | None:
    """key and value: of a state what it leaves to the shorter one, of a state's stored continuation its probability."""
    shorter = counts.select(F.lit(0).cast("long").alias("short"), F.col("word").alias("next"), ((F.col("c") + 0.1) / (total + 0.1 * (distinct + 1))).alias("before"))
    empty = F.lit(0).cast("long")
    contexts = counts.where(F.col("c") >= CONTEXT_LEAST).select(empty.alias("ctx"), empty.alias("short"), F.col("word").alias("next"), F.col("c").alias("n"))
    parts = []
    for depth in range(1, DEPTH + 1):
        # as END ends a text, it is in no context
        contexts = work.write(f"contexts{depth}", contexts.where(F.col("next") != int(END.astype(np.int64))).mapInArrow(_longer, "ctx long, short long, c long"))
        if contexts.isEmpty():
            break
        part, stored = _deeper(work, blocks, contexts, shorter, depth, bits)
        parts.append(part)
        work.drop(f"contexts{depth}", f"followed{depth}", f"states{depth}", f"stored{depth - 1}")
        shorter = stored.select(F.col("ctx").alias("short"), "next", F.col("value").alias("before"))
        contexts = stored.where(F.col("n") >= CONTEXT_LEAST).select("ctx", "short", "next", "n")
    work.drop(f"contexts{len(parts) + 1}", f"stored{len(parts)}")
    return reduce(DataFrame.unionByName, parts) if parts else None


def _deeper(work: _Work, blocks: DataFrame, contexts: DataFrame, shorter: DataFrame, depth: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The model's part of a depth, and the stored continuations of its contexts."""
    sieve = _sieve(contexts.select(F.col("ctx").alias("key")))
    trained = blocks.where(F.exists("held", lambda h: ~h)).select("held", "bounds", "places", "words")
    packed = trained.mapInArrow(_continuations(sieve, depth, bits), "range long, ctx binary, next binary, n binary")
    pairs = packed.groupBy("range").applyInArrow(_merged, "ctx long, next long, n long")
    # a stored continuation is stored without the oldest word too
    followed = work.write(f"followed{depth}", pairs.join(contexts, "ctx").join(shorter, ["short", "next"]))
    work.drop()
    share = F.col("n") / F.col("c")
    sums = followed.groupBy("ctx").agg(F.first("c").alias("sum"), F.sum("n").alias("kept"), F.sum("before").alias("b"), F.sum(share * F.log(share / F.col("before"))).alias("gain"))
    left = 1 - F.col("kept") / F.col("sum")
    rest = F.when(left > 1e-9, left * F.log(left / F.greatest(1 - F.col("b"), F.lit(1e-9)))).otherwise(0.0)
    leaves = (F.col("sum") - F.col("kept") + SMOOTH) / (F.col("sum") + SMOOTH)
    states = work.write(f"states{depth}", sums.where(F.col("sum") * (F.col("gain") + rest) >= DIVERGENCE).select("ctx", leaves.alias("leaves")))
    after = F.when(F.col("leaves").isNull(), F.col("before")).otherwise(F.col("n") / (F.col("c") + SMOOTH) + F.col("leaves") * F.col("before"))
    stored = work.write(f"stored{depth}", followed.join(states, "ctx", "left").select("ctx", "short", "next", "n", after.alias("value"), F.col("leaves").isNotNull().alias("state")))
    keyed = stored.where("state").select("ctx", "next", "value").mapInArrow(_keyed, "key long, value double")
    return work.write(f"model{depth}", states.select(F.col("ctx").alias("key"), F.col("leaves").alias("value")).unionByName(keyed)), stored


def _extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more word at their end; the empty context is 0."""
    return mixed(context * np.uint64(3) + word)


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts made longer by what follows them, and the same without the oldest word."""
    for batch in batches:
        ctx, short, word = (_hashes(batch.column(c)) for c in ("ctx", "short", "next"))
        # a single word's shorter context is the empty one, as is that of the empty one
        shorter = np.where(ctx == 0, np.uint64(0), _extended(short, word))
        yield pa.RecordBatch.from_arrays([pa.array(_extended(ctx, word).view(np.int64)), pa.array(shorter.view(np.int64)), batch.column("n")], ["ctx", "short", "c"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored continuations by one key: the complement of the longer context's, which a state may have."""
    for batch in batches:
        key = ~_extended(_hashes(batch.column("ctx")), _hashes(batch.column("next")))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("value")], ["key", "value"])


@dataclass
class Sieve:
    """A bitmap of hashes: those not in it are certainly not in the table."""

    bits: int
    packed: Broadcast

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _sieve(keys: DataFrame) -> Sieve:
    bits = min(SIEVE_BITS, max(16, (16 * keys.count()).bit_length()))
    size = 1 << (bits - RANGE_BITS)

    def run(part: pa.Table) -> pa.Table:
        cells = np.zeros(size, np.uint8)
        hashes = _hashes(part.column("key"))
        cells[(hashes >> np.uint64(64 - bits)).astype(np.int64) & (size - 1)] = 1
        return pa.table({"range": pa.array([part.column("range")[0].as_py()], pa.int64()), "cells": pa.array([np.packbits(cells).tobytes()], pa.binary())})

    ranged = keys.select(F.shiftrightunsigned("key", 64 - RANGE_BITS).alias("range"), "key")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in ranged.groupBy("range").applyInArrow(run, "range long, cells binary").toArrow().to_pylist():
        start = row["range"] * (size >> 3)
        out[start : start + (size >> 3)] = np.frombuffer(row["cells"], np.uint8)
    return Sieve(bits, keys.sparkSession.sparkContext.broadcast(out))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: each text's words and end as places in the block's dictionary, with the training counts of its words."""
    task, made = TaskContext.get().partitionId(), 0
    for parts in _gathered(batches):
        ids, held, counts, tokens = (pa.concat_arrays(p) if k < 2 else np.concatenate(p) for k, p in enumerate(zip(*parts, strict=True)))
        known, places = np.unique(tokens, return_inverse=True)
        trained = np.bincount(places[np.repeat(~held.to_numpy(zero_copy_only=False), counts)], minlength=len(known))
        yield _block(task << 32 | made, ids, held, np.concatenate([[0], np.cumsum(counts)]), places, known, trained)
        made += 1


def _block(number: int, ids: pa.Array, held: pa.Array, bounds: np.ndarray, places: np.ndarray, known: np.ndarray, trained: np.ndarray) -> pa.RecordBatch:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    data = [pa.array([x.tobytes()], pa.binary()) for x in (places.astype("<u4"), known.astype("<u8"), trained.astype("<i8"))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(ids), one(held), one(pa.array(bounds.astype(np.int64))), *data], ["block", "ids", "held", "bounds", "places", "words", "counts"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Ids, marks, token counts and tokens of texts, in parts that add up to about ``BLOCK_BYTES`` of text."""
    parts, size = [], 0
    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"))
            counts = np.diff(words.bounds)
            tokens = np.full(len(words.hash) + len(counts), END)
            tokens[np.arange(len(words.hash)) + np.repeat(np.arange(len(counts)), counts)] = words.hash
            parts.append((piece.column("doc_id"), piece.column("held"), counts + 1, tokens))
            size += len(words.data)
            if size >= BLOCK_BYTES:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def _dictionary(bits: int):
    """Training counts of each block's words, packed by ranges of the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["counts"], "<i8")
            words, counts = words[counts > 0], counts[counts > 0].astype("<u4")
            ranges, cuts = _cut(words, bits)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), _spaced(words, cuts), _lists(counts, cuts)], ["range", "words", "n"])

    return run


def _summed(part: pa.Table) -> pa.Table:
    """The counts of a range's words, all blocks together."""
    words = np.concatenate([_joined(x) for x in part.column("words").to_pylist()])
    index, sums = _totals(words, _unpacked(part.column("n"), "<u4"))
    return pa.table({"word": pa.array(words[index].view(np.int64)), "c": pa.array(sums)})


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct key is, in the keys' order, and the sum of its numbers."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    starts = np.flatnonzero(_new(keys[order]))
    return order[starts], np.add.reduceat(n[order].astype(np.int64), starts)


@dataclass
class Tree:
    """The same tree in one process, for small alphabets: tests hold the tables against it.

    States and stored continuations by depth; symbol numbers follow the hashes'
    order, the last stands for all words left out.
    """

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    context_least: int
    #: By depth: keys (shorter context, word) of the contexts followed, their counts, whether each is a state.
    keys: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)
    states: list[np.ndarray] = field(default_factory=list)
    #: By depth: keys (context, next symbol) of stored continuations, and their counts.
    next_keys: list[np.ndarray] = field(default_factory=list)
    next_counts: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of_symbols(cls, found: pa.Table, total: int, distinct: int) -> Tree:
        words = found.column("word").to_numpy().astype(np.int64).view(np.uint64)
        counts = found.column("c").to_numpy().astype(np.int64)
        order = np.argsort(words)
        tree = cls(words[order], counts[order], total, distinct, CONTEXT_LEAST)
        fit = np.flatnonzero((tree.counts >= tree.context_least) & (tree.words != END))
        tree.keys.append(fit.astype(np.int64))
        tree.sums.append(tree.counts[fit])
        return tree

    @property
    def base(self) -> int:
        """How many symbols there are, the rare class included."""
        return len(self.words) + 1

    def root(self) -> np.ndarray:
        """The add-0.1 distribution over the symbols; the rare class has the rest."""
        shares = (self.counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        return np.append(shares, max(1.0 - shares.sum(), 1e-12))

    def deepen(self, found: pa.Table) -> bool:
        """Takes in the continuations of the deepest contexts; whether there are longer contexts to follow."""
        keys, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
        self.next_keys.append(keys)
        self.next_counts.append(counts)
        self.states.append(self._diverging(keys, counts))
        symbol = keys % self.base
        end = np.searchsorted(self.words, END)
        fit = (counts >= self.context_least) & (symbol != self.base - 1) & (symbol != end)
        self.keys.append(keys[fit])
        self.sums.append(counts[fit])
        return bool(fit.any())

    def _diverging(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which of the deepest contexts tell more than the same without the oldest word."""
        depth = len(self.next_keys) - 1
        context, symbol = keys // self.base, keys % self.base
        sums = self.sums[depth]
        shorter = self._path_probability(depth, context, symbol)
        share = counts / sums[context]
        gain = np.bincount(context, share * np.log(share / shorter), minlength=len(sums))
        left = 1 - np.bincount(context, share, minlength=len(sums))
        left_shorter = 1 - np.bincount(context, shorter, minlength=len(sums))
        rest = np.where(left > 1e-9, left * np.log(np.maximum(left, 1e-9) / np.maximum(left_shorter, 1e-9)), 0)
        return sums * (gain + rest) >= DIVERGENCE

    def _path_probability(self, depth: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """P(symbol | the context without its oldest word) by the states so far."""
        spelled = np.zeros((len(context), depth + 1), np.int64)
        at = context
        for k in range(depth, 0, -1):
            spelled[:, k], at = self.keys[k][at] % self.base, self.keys[k][at] // self.base
        spelled[:, 0] = self.keys[0][at]
        probability = self.root()[symbol]
        for length in range(1, depth + 1):
            state = self.lookup(spelled[:, depth + 1 - length :])
            probability = self.refined(length - 1, state, symbol, probability)
        return probability

    def lookup(self, spelled: np.ndarray) -> np.ndarray:
        """Numbers of contexts spelled out, -1 where there is none."""
        state = _place(self.keys[0], spelled[:, 0])
        for k in range(1, spelled.shape[1]):
            state = np.where(state >= 0, _place(self.keys[k], state * self.base + spelled[:, k]), -1)
        return state

    def refined(self, depth: int, state: np.ndarray, symbol: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probability by the context of this depth where it is a state, else as before."""
        known = np.flatnonzero(state >= 0)
        known = known[self.states[depth][state[known]]]
        if not len(known):
            return shorter
        s, stored = state[known], self.next_counts[depth]
        at = _place(self.next_keys[depth], s * self.base + symbol[known])
        own = np.where(at >= 0, stored[at] if len(stored) else 0, 0)
        sums = self.sums[depth]
        left = sums - np.bincount(self.next_keys[depth] // self.base, stored, minlength=len(sums)) + SMOOTH
        out = shorter.copy()
        out[known] = (own + left[s] * shorter[known]) / (sums[s] + SMOOTH)
        return out


def _place(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is among the ordered ones, -1 where it isn't."""
    if not len(ordered):
        return np.full(len(values), -1, np.int64)
    if len(values) < SORTED_LEAST or not (values[1:] < values[:-1]).any():
        at = np.searchsorted(ordered, values)
    else:  # one after the other they are found in the processor's cache
        order = np.argsort(values)
        at = np.empty(len(values), np.int64)
        at[order] = np.searchsorted(ordered, values[order])
    at = np.minimum(at, len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the texts, places of their tokens in the dictionary, tokens, and how many of its text are before each."""
    bounds, places = np.array(row["bounds"], np.int64), np.frombuffer(row["places"], "<u4")
    tokens = np.frombuffer(row["words"], "<u8").astype(np.uint64)[places]
    return bounds, places, tokens, np.arange(len(places), dtype=np.int32) - np.repeat(bounds[:-1].astype(np.int32), np.diff(bounds))


def _contexts(tokens: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By depth: places of the tokens with so many words before them, and the hashes of those words."""
    context = np.zeros(len(tokens), np.uint64)
    for depth in range(1, DEPTH + 1):
        context[1:] = _extended(context[:-1], tokens[:-1])
        at = np.flatnonzero(before >= depth)
        yield at, context[at]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def _continuations(sieve: Sieve, depth: int, bits: int):
    """Counts of what follows the contexts of a depth, by block, packed by ranges of the longer contexts' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            bounds, _, tokens, before = _tokens(row)
            for _, (at, context) in zip(range(depth), _contexts(tokens, before), strict=False):
                pass
            used = sieve.holds(context) & np.repeat(~np.array(row["held"], bool), np.diff(bounds))[at]
            context, after = context[used], tokens[at[used]]
            del row, tokens, before, at, used  # the longest arrays but those
            longer = _extended(context, after)
            index, n = _totals(longer, np.ones(len(longer), np.uint8))
            longer = longer[index]
            ranges, cuts = _cut(longer, bits)
            # equal contexts side by side in their range, which compresses
            spread = np.uint64(64 - bits)
            order = np.argsort((longer >> spread << spread) | (context[index] >> np.uint64(bits)))
            del longer
            columns = (context[index[order]], after[index[order]], n[order].astype("<u4"))
            del context, after, index, order, n
            for k in range(0, len(ranges), HANDED):
                part = [pa.array(ranges[k : k + HANDED]), *(_lists(x, cuts[k : k + HANDED + 1]) for x in columns)]
                yield pa.RecordBatch.from_arrays(part, ["range", "ctx", "next", "n"])

    return run


def _cut(ordered: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of hashes, by their first bits, that ordered ones lie in, and where each begins, with the end."""
    ranges = ordered >> np.uint64(64 - bits)
    starts = np.flatnonzero(_new(ranges))
    return ranges[starts].astype(np.int64), np.append(starts, len(ordered))


def _new(ordered: np.ndarray) -> np.ndarray:
    """Whether each of the ordered values is the first of its kind."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[_new(ordered)]


def _spaced(keys: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Each part of the ordered keys as its first key and the steps to the next ones, in as many bytes as the largest asks for."""
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        steps = np.diff(keys[a:b]).astype("<u8")
        width = (int(steps.max(initial=0)).bit_length() + 7) // 8
        out.append(keys[a : a + 1].astype("<u8").tobytes() + bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    return pa.array(out, pa.binary())


def _joined(packed: bytes) -> np.ndarray:
    """Keys from their steps."""
    width = packed[8]
    steps = np.zeros(((len(packed) - 9) // width if width else 0, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(len(steps), width)
    return np.cumsum(np.concatenate([np.frombuffer(packed, "<u8", 1), steps.view("<u8")[:, 0]]), dtype=np.uint64)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of each part of the values."""
    return pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _merged(part: pa.Table) -> pa.Table:
    """The continuations of a range that occur often enough, all blocks together."""
    context, after, n = (_unpacked(part.column(c), k) for c, k in (("ctx", "<u8"), ("next", "<u8"), ("n", "<u4")))
    index, sums = _totals(_extended(context, after), n)
    kept = sums >= NEXT_LEAST
    index = index[kept]
    return pa.table({"ctx": pa.array(context[index].view(np.int64)), "next": pa.array(after[index].view(np.int64)), "n": pa.array(sums[kept])})


def _needed(sieve: Sieve | None, tokens: np.ndarray, before: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Keys, in order, of the rare words, states and stored continuations that a block may need."""
    keys = [rare]
    for at, context in _contexts(tokens, before) if sieve else ():
        fit = sieve.holds(context)
        after = ~_extended(context[fit], tokens[at[fit]])
        keys += [_distinct(context[fit]), _distinct(after[sieve.holds(after)])]
    return _distinct(np.concatenate(keys))


def _asked(shared: Broadcast, sieve: Sieve | None, bits: int):
    """The keys that each block needs, packed by ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, tokens, before = _tokens(row)
            words = np.frombuffer(row["words"], "<u8")
            keys = _needed(sieve, tokens, before, words[_place(shared.value[0], words.view(np.int64)) < 0])
            ranges, cuts = _cut(keys, bits)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(np.full(len(ranges), row["block"], np.int64)), _spaced(keys, cuts)], ["range", "block", "packed"])

    return run


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The values of each list of keys in its order, not a number where the model has none."""
    known = _hashes(model.column("key"))
    order = np.argsort(known)
    known, values = known[order], np.append(model.column("value").to_numpy()[order], np.nan)
    found = [values[_place(known, _joined(keys))].tobytes() for keys in asked.column("packed").to_pylist()]
    return pa.table({"range": asked.column("range").cast(pa.int64()), "block": asked.column("block").cast(pa.int64()), "packed": pa.array(found, pa.binary())})


def _scores(shared: Broadcast, sieve: Sieve | None, total: int, distinct: int):
    def run(block: pa.Table, needed: pa.Table) -> pa.Table:
        parts = [_scored(block.slice(k, 1).to_pylist()[0], needed, shared.value, sieve, total, distinct) for k in range(block.num_rows)]
        names = [c.split()[0] for c in SCORES.split(", ")]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = [pa.chunked_array([pa.array(p[k], t) for p in parts], t) for k, t in enumerate(kinds)]
        return pa.Table.from_arrays(columns, names)

    return run


def _scored(row: dict, needed: pa.Table, frequent: tuple[np.ndarray, np.ndarray], sieve: Sieve | None, total: int, distinct: int) -> tuple:
    bounds, places, tokens, before = _tokens(row)
    words, counts = np.frombuffer(row["words"], "<i8"), np.zeros(len(row["words"]) // 8, np.int64)
    own = _place(frequent[0], words)
    counts[own >= 0] = frequent[1][own[own >= 0]]
    rare = words[own < 0].view(np.uint64)
    keys, values = _needed(sieve, tokens, before, rare), _unpacked(needed.sort_by("range").column("packed"), "<f8")
    keys, values = keys[~np.isnan(values)], np.append(values[~np.isnan(values)], 0.0)
    counts[own < 0] = values[_place(keys, rare)]  # 0 of words without a training text
    base = ((counts + 0.1) / (total + 0.1 * (distinct + 1)))[places]
    probability = base.copy()
    for at, context in _contexts(tokens, before) if sieve else ():
        fit = sieve.holds(context)
        at, context = at[fit], context[fit]
        state = _place(keys, context)
        at, context, state = (x[state >= 0] for x in (at, context, state))
        after = ~_extended(context, tokens[at])
        stored, fit = np.full(len(at), -1), sieve.holds(after)
        stored[fit] = _place(keys, after[fit])
        probability[at] = np.where(stored >= 0, values[stored], values[state] * probability[at])
    sums = lambda x: np.add.reduceat(x, bounds[:-1])
    return row["ids"], row["held"], np.diff(bounds), sums((counts > 0)[places].astype(np.int64)), sums(np.log10(base)), sums(np.log10(probability))
