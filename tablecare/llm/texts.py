"""Shared helpers: input columns, and texts of an Arrow batch as bytes, words and hashes of words.

Every operator reads its id and text columns by name and ignores all others,
so further columns, also ones named like its results, do no harm.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a mapper holds as arrays at a time, a longer single text apart.
SLICE_BYTES = 1 << 20


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns as ``doc_id`` long and ``text`` string; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, whole rows each."""
    if not batch.num_rows:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()  # several workers share an executor's memory


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of every text."""
    return np.diff(raw(column)[1])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and the bounds of each (one more than texts)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads near values (two multiply-and-shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Memory(dict):
    """Values found by ``make`` at first use; emptied between texts when it holds ``most``, which changes no result."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


#: A random odd factor, its inverse modulo 2^64, and a random value for each byte.
FACTOR = 0x5851F42D4C957F2D
INVERSE = pow(FACTOR, -1, 1 << 64)
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; those for usual slices are kept."""
    usual = SLICE_BYTES + (1 << 17)
    if n > usual:
        return _doubled(n, base)
    if base not in _powers:
        _powers[base] = _doubled(usual, base)
    return _powers[base][:n]


def _doubled(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base & (2**64 - 1))
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
        with np.errstate(over="ignore"):
            step = step * step
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts of a column, or runs of bytes not ``apart``; A-Z lower-cased.

    ``hash`` has one 64-bit value a word, ``first`` and ``last`` its byte
    range, ``bounds`` the range of words of each text.
    """

    def __init__(self, column: pa.Array, apart: np.ndarray = BLANK):
        data, ends = raw(column)
        self.data, self.ends = LOWER[data], ends
        blank = apart[data]
        edge = np.ones(len(data) + 1, bool)  # a byte before which there is no word
        edge[1:] = blank
        edge[ends] = True
        solid = ~blank
        self.first = np.flatnonzero(solid & edge[:-1])
        shut = np.ones(len(data) + 1, bool)
        shut[:-1] = ~solid
        shut[ends] = True
        self.last = np.flatnonzero(solid & shut[1:]) + 1
        self.bounds = np.searchsorted(self.first, ends)
        self.up = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(len(data), FACTOR), out=self.up[1:])
        self.down = powers(len(data) + 1, INVERSE)
        self.hash = self.spans(self.first, self.last)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they are."""
        return mixed((self.up[last] - self.up[first]) * self.down[first] + (last - first).astype(np.uint64))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and which text each is from.

    A text of fewer words, but one at least, gives its whole sequence as one.
    """
    h, counts = words.hash, np.diff(words.bounds)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        out[: n - k] = mixed(out[: n - k] * np.uint64(3) + h[k:])
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(n) + size <= words.bounds[owner + 1]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        value = np.zeros(1, np.uint64)
        for k in range(words.bounds[i], words.bounds[i + 1]):
            value = mixed(value * np.uint64(3) + h[k : k + 1])
        at = words.bounds[i]
        out[at], whole[at] = mixed(value + counts[i].astype(np.uint64))[0], True
    return out[whole], owner[whole]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tablecare-")) / f"{package.name}.zip"  # the driver serves it to executors
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
