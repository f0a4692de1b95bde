"""Token-ID files: Parquet with one list of ids a document, laid out for selective reads.

``write_token_files`` range-partitions documents by id, encodes them with the
tokenizers library and writes one file a partition, rows in ascending id order.
Columns of a file: ``part`` (its number), ``part_start`` (ids of all documents
before this one in the file), ``doc_id``, ``n_tokens``, ``ids`` (list of int).
Ids are dictionary-encoded (a vocabulary fits in one dictionary page), the
number columns delta-encoded; pages hold few rows and have a page index, so a
filter on ``doc_id`` reads few pages of ``ids``, and a read of the counts none.

Defined cases: a null text is empty; an empty text has the end id alone; equal
doc_ids follow each other in the order of a hash of their texts; null doc_ids
come first; an empty table gives an empty folder with the schema.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecare.llm.texts import Memory, id_and_text, slices

FILE_SCHEMA = "part int, part_start long, doc_id long, n_tokens long, ids array<int>"

#: Words whose ids a worker remembers; the memory is emptied when full, results don't change.
REMEMBERED = 900_000

#: Letters of which the pre-tokenizer makes one piece, with nothing to compose or split.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class Encoder:
    """The tokenizers library with a memory of whole words.

    The pre-tokenizer of the file drops white space and never joins over it,
    so a text's ids are those of its words, one after the other.  Where its
    parts are seen to act letter by letter, a word of plain letters goes to
    the library's model directly, without a mark that may follow it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = re.compile(f"[{_LETTERS}]+")
        self.marks = {m: self._whole(m) for m in ".,"}
        self.spelled = self._spelling()
        tried = ["The", "Reed.", "inding,", "Zq", "été.", "ÑÄß", "I.", "xX,"]
        self.plain = bool(self.spelled) and all(self._by_letters(w) == self._whole(w) for w in tried)
        self.words = Memory(self._find, REMEMBERED)

    def _spelling(self) -> dict[int, str]:
        """What normaliser and pre-tokenizer make of each letter."""
        made = {}
        for c in filter(self.letters.fullmatch, map(chr, range(256))):
            text = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if self.tokenizer.pre_tokenizer else [(text, None)]
            if len(pieces) != 1:
                return {}
            made[ord(c)] = pieces[0][0]
        return made

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _by_letters(self, word: str) -> bytes | None:
        mark = self.marks.get(word[-1:], b"")
        body = word[:-1] if mark else word
        if not self.letters.fullmatch(body):
            return None
        return array("I", [t.id for t in self.model.tokenize(body.translate(self.spelled))]).tobytes() + mark

    def _find(self, word: str) -> bytes:
        if not word:
            return b""
        if self.plain:
            if word[-1] in self.marks and len(word) > 1:
                body = word[:-1].lower()
                if self.letters.fullmatch(body):
                    return self.words[body] + self.marks[word[-1]]
            elif (found := self._by_letters(word)) is not None:
                return found
        return self._whole(word)

    def ids(self, text: str) -> bytes:
        """Ids of the text as little-endian 32-bit integers."""
        self.words.trim()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 200,
) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the files."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start, end = encoder(tokenizer), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in slices(batch):
                found = [enc.ids(t) + end for t in piece.column("text").to_pylist()]
                counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
                ends = np.cumsum(counts)
                ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), part, np.int32)), pa.array(start + ends - counts), piece.column("doc_id"), pa.array(counts), lists],
                    ["part", "part_start", "doc_id", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    writer = rows.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for name in ("part", "part_start", "doc_id", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer = writer.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
    writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start (ids of all documents before it) and n_tokens, without reading any id."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return _with_start(files.select("part", "part_start", "doc_id", "n_tokens"), files).select("part", "doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and ids, of the documents between two ids if given; the page index leads to their pages."""
    found = spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "ids")
    if first is not None:
        found = found.where(F.col("doc_id") >= first)
    return found if last is None else found.where(F.col("doc_id") <= last)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            kept = [batch.column(c) for c in ("part", "part_start", "doc_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "part_start", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    found = files.select("part", "part_start", "doc_id", "ids").mapInArrow(crc, "part int, part_start long, doc_id long, n_tokens long, ids_crc32 long")
    return _with_start(found, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def _with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the ids of all earlier files, one row a file, to each row's place in its own."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("earlier"))
    return rows.join(sums, "part").withColumn("start", F.col("earlier") + F.col("part_start"))
