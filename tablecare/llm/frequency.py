"""How frequent hashed values are in a whole table, as levels in a table of fixed size.

Tasks count 32-bit forms and hand them on sorted, as steps between them, dealt
out by range; a range's counts become levels of the cells that its values fall
in.  Values that share a form or a cell are at least as frequent as they seem,
so level 0 is certain: a value that occurs once only.  As a table grows, more
cells are shared, which costs time and no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablecare.llm.texts import slices

#: Cells, a byte each: the bound of what is collected and broadcast.
BUCKET_BITS = 24
BUCKETS = 1 << BUCKET_BITS
#: Values that a task counts at a time.
COUNTED = 4_000_000


def level_of(levels: np.ndarray, values: np.ndarray) -> np.ndarray:
    return levels[(values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]


def _partial_counts(values, ranges: int):
    """Sorted 32-bit forms of the values and how often the task has them, by range, compressed."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        ids, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(ids, np.arange(ranges + 1, dtype=np.uint64) * np.uint64((1 << 32) // ranges))
        rows = [(r, zlib.compress(np.diff(ids[a:b], prepend=ids[a : a + 1]).astype("<u4").tobytes(), 1), zlib.compress(n[a:b].astype("<u4").tobytes(), 1), int(ids[a])) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        names, kinds = ["range", "steps", "times", "first"], (pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in slices(batch):
                for own in values(piece.column("text")):
                    held.append(own >> np.uint64(32))
                    n += len(own)
                if n >= COUNTED:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _levels(ranges: int, least: tuple[int, ...]):
    """The frequency table's cells of one range."""

    def run(part: pa.Table) -> pa.Table:
        ids, times = [], []
        for row in part.to_pylist():
            ids.append(np.cumsum(np.frombuffer(zlib.decompress(row["steps"]), "<u4"), dtype=np.int64) + row["first"])
            times.append(np.frombuffer(zlib.decompress(row["times"]), "<u4"))
        found, place = np.unique(np.concatenate(ids), return_inverse=True)
        level = np.digitize(np.bincount(place, np.concatenate(times)), least).astype(np.uint8)
        number = part.column("range")[0].as_py()
        cells = np.zeros(BUCKETS // ranges, np.uint8)
        np.maximum.at(cells, (found >> (32 - BUCKET_BITS)) - number * (BUCKETS // ranges), level)
        return pa.table({"range": pa.array([number], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())})

    return run


def frequency_levels(rows: DataFrame, values, least: tuple[int, ...]) -> np.ndarray:
    """The level of each cell: how many of the numbers ``least`` its most frequent value's count reaches.

    ``values`` gives arrays of 64-bit hashes for a column of texts.  The result
    has ``BUCKETS`` bytes whatever the table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << min(16, max(8, parts.bit_length() + 2))  # of the 32-bit forms, several for each reducer
    partial = rows.mapInArrow(_partial_counts(values, ranges), "range int, steps binary, times binary, first long")
    cells = partial.groupBy("range").applyInArrow(_levels(ranges, least), "range int, cells binary").toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    for row in cells.to_pylist():
        start = row["range"] * (BUCKETS // ranges)
        out[start : start + BUCKETS // ranges] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return out
