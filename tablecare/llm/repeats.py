"""Long substrings that occur more than once, by suffix arrays around content-chosen anchors.

Every ``LENGTH``-byte string holds ``LENGTH - GRAM + 1`` strings of ``GRAM``
bytes; the one of least hash is its anchor.  Equal strings have equal anchors at
equal places, so all repeats are found by comparing what surrounds equal
anchors: up to ``BEFORE`` bytes before and ``LENGTH`` bytes from the anchor on.
Anchors whose gram occurs once (by a frequency table of fixed size) are dropped
at once, and equal surroundings become one class with a count; a class that
occurs twice is a repeat by itself.

The other classes meet in groups: a repeat reaches either ``HALF`` bytes to the
right or the rest to the left, so classes are dealt out by these parts.  A
group's members are sorted by what follows the anchor into a suffix array with
common-prefix lengths; a stack scan gives the tree of common-prefix intervals,
whose members agree on that many bytes to the right.  Within an interval, runs
that agree far enough to the left, and are diverse before that, are maximal
repeats, and all members of a run their occurrences.  A group of more than
``MEMBERS`` classes is not gathered: its classes' windows are counted one by one.

Matches never cross documents.  Surroundings are told apart by 128-bit hashes
where they are counted, and by their bytes in the arrays.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` keep all
their bytes; equal texts, also of one id, repeat each other; a table without
rows gives none.  Other columns pass through ``remove_repeated``, whatever
their names; bytes left over that are no UTF-8 become U+FFFD there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.frequency import frequency_levels, level_of
from tablecare.llm.texts import BYTE_VALUES, FACTOR, INVERSE, mixed, powers, raw, ship, slices
from tablecare.sources.session import cut_lineage

LENGTH, GRAM = 200, 32
BEFORE = LENGTH - GRAM
HALF = GRAM + BEFORE // 2
#: Classes of a group that a task holds at a time (about 0.7 kB each), and tasks that a larger group is dealt out to.
MEMBERS, SALTS = 100_000, 64
#: Hashes that an anchor is chosen among.
WINDOW = LENGTH - GRAM + 1
#: Places that fit beside a hash in 64 bits; longer texts are gone through in pieces.
PLACE_BITS = 23


class Bytes:
    """Texts end to end, with hashes of any of their byte ranges."""

    def __init__(self, texts: pa.Array):
        self.data, self.ends = raw(texts)
        self.up = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(len(self.data), FACTOR), out=self.up[1:])
        self.down = powers(len(self.data) + 1, INVERSE)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.up[last] - self.up[first]) * self.down[first] + (last - first).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all texts' anchors, their grams' hashes, and which text each is from."""
        n, found = len(self.data), []
        step = (1 << PLACE_BITS) - LENGTH
        for start in range(0, max(n - LENGTH + 1, 0), step):
            stop = min(n, start + step + LENGTH - 1)
            found.append(self._anchors(start, stop))
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        # an anchor's hash is the least of many: spread anew, or all would share a corner of the frequency table
        return at, mixed(self.hashes(at, at + GRAM) + np.uint64(5)), np.searchsorted(self.ends, at, side="right") - 1

    def _anchors(self, start: int, stop: int) -> np.ndarray:
        grams = np.arange(start, stop - GRAM + 1)
        key = self.hashes(grams, grams + GRAM) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
        key |= (grams - start).astype(np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = WINDOW - width
        least = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        windows = np.arange(start, start + len(least))
        owner = np.searchsorted(self.ends, windows, side="right") - 1
        inside = windows + LENGTH <= self.ends[owner + 1]
        places = (least[inside] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + start
        return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def _grams(texts: pa.Array) -> Iterator[np.ndarray]:
    if len(texts):
        yield Bytes(texts).anchors()[1]


ANCHORS = "doc_id long, text_hash long, at int, gram long, class long, before short, after short, right int, left int"
#: Bytes before and from the anchor on that matter in a group that agrees to the right, and to the left.
PARTS = ((LENGTH - HALF, LENGTH), (BEFORE, HALF - 1))


def _anchor_rows(shared: Broadcast):
    """Anchors whose gram may occur again, with hashes of their surroundings and of the parts that classes are dealt out by."""
    names = [c.split()[0] for c in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for piece in slices(batch):
                texts = Bytes(piece.column("text"))
                at, gram, owner = texts.anchors()
                again = level_of(levels, gram) > 0
                at, gram, owner = at[again], gram[again], owner[again]
                first, last = np.maximum(at - BEFORE, texts.ends[owner]), np.minimum(at + LENGTH, texts.ends[owner + 1])
                surroundings = texts.hashes(first, last) ^ mixed((at - first).astype(np.uint64) + np.uint64(7))
                # parts cut off by an end of the text can't be long enough: they get a value of their own
                own = mixed(surroundings + np.uint64(99))
                right = np.where(last - at >= HALF, texts.hashes(at, np.minimum(at + HALF, last)), own)
                left = np.where(at - first >= LENGTH - HALF, texts.hashes(np.maximum(at - (LENGTH - HALF), first), at + GRAM), own + np.uint64(1))
                rows = pa.array(owner)
                kept = [piece.column(c).take(rows) for c in ("doc_id", "text_hash")]
                short = lambda x: (x >> np.uint64(32)).astype(np.uint32).view(np.int32)  # noqa: E731  a mix-up costs time only
                numbers = [(at - texts.ends[owner]).astype(np.int32), gram.view(np.int64), surroundings.view(np.int64), (at - first).astype(np.int16), (last - at).astype(np.int16), short(right), short(left)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, numbers)], names)

    return run


FOUND = "group long, members long, gram long, class long, n long, left binary, right binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group that a class is in, with the bytes around the anchor that matter there."""
    kinds, names = (*[pa.int64()] * 5, pa.binary(), pa.binary()), [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            text, rows = batch.column("text")[i].as_py().encode(), []
            for x in batch.column("wanted")[i].as_py():
                before, after = PARTS[x["side"]]
                at = x["at"]
                rows.append((x["group"], x["members"], x["gram"], x["class"], x["n"], text[max(at - before, 0) : at], text[at : at + after]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the tree of common-prefix intervals, inner ones first.

    ``depths[i]`` is what sorted suffixes i and i + 1 have in common.
    """
    stack: list[tuple[int, int]] = []  # depth, first member
    for i, depth in enumerate([*depths, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            deeper, first = stack.pop()
            yield deeper, first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(members: list[tuple[bytes, bytes]], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes from the anchor on, members) of the maximal repeats of ``least`` bytes or more around one anchor.

    A member is what stands before the anchor, and what from it on.
    """
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    right = [members[i][1] for i in order]
    depths = [common(a, b) for a, b in zip(right, right[1:], strict=False)]
    mirrored = {i: members[i][0][::-1] for i in order}
    longest = max((len(m) for m in mirrored.values()), default=0)
    seen: set[tuple[int, ...]] = set()
    for depth, first, last in intervals(depths):
        if depth + longest < least:
            continue
        inside = sorted(order[first : last + 1], key=mirrored.__getitem__)
        lefts = [common(mirrored[a], mirrored[b]) for a, b in zip(inside, inside[1:], strict=False)]
        # runs that agree far enough to the left, and every longer agreement within them
        for left, a, b in intervals([x + 1 for x in lefts]):  # one more, so that a repeat may start at the anchor
            left -= 1
            if left + depth >= least:
                run = inside[a : b + 1]
                mark = (left, *sorted(run))
                if mark not in seen:  # a deeper interval with the same members has the longer repeat
                    seen.add(mark)
                    yield left, depth, run


MET = "gram long, class long, n long, before int, after int, group long, offset int, window binary"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far around the anchor classes that occur once are covered by repeats; of large groups, windows to be counted.

    Rows come in order of group; a large group isn't gathered, its rows may be anywhere.
    """
    group, members, rows = None, {}, []

    def close() -> None:
        alone = {k for k, (n, *_) in members.items() if n == 1}
        names = list(members)
        if len(names) < 2 or not alone:
            return
        best: dict[tuple, list[int]] = {}
        for left, right, run in maximal_repeats([members[k][1:] for k in names]):
            for i in run:
                if names[i] in alone:
                    reach = best.setdefault(names[i], [0, 0])
                    reach[0], reach[1] = max(reach[0], left), max(reach[1], right)
        rows.extend((*k, 1, *reach, None, None, None) for k, reach in best.items())

    for batch in batches:
        for own, size, gram, kind, n, left, right in zip(*(batch.column(c).to_pylist() for c in ("group", "members", "gram", "class", "n", "left", "right")), strict=True):
            if size > MEMBERS:
                whole = left + right
                for s in range(len(whole) - LENGTH + 1):
                    rows.append((gram, kind, n, None, None, own, len(left) - s, hashlib.blake2b(whole[s : s + LENGTH], digest_size=16).digest()))
                if len(rows) > 50_000:
                    yield _met_rows(rows)
                    rows = []
                continue
            if own != group:
                close()
                group, members = own, {}
            members[gram, kind] = n, left, right
        if rows:
            yield _met_rows(rows)
            rows = []
    close()
    if rows:
        yield _met_rows(rows)


def _met_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in MET.split(", ")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash that tells texts of one id apart, and the text."""
    ship(docs.sparkSession)
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


_SAME = "l.doc_id <=> r.doc_id and l.text_hash = r.text_hash"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text_hash of each text with repeated strings, and spans (first byte, end) that cover them all."""
    rows = _keyed(docs, id_col, text_col).where(F.octet_length("text") >= LENGTH)
    shared = docs.sparkSession.sparkContext.broadcast(frequency_levels(rows, _grams, (2,)))
    anchors = cut_lineage(rows.mapInArrow(_anchor_rows(shared), ANCHORS))
    first = F.min(F.struct("doc_id", "text_hash", "at"))
    classes = cut_lineage(anchors.groupBy("gram", "class", "before", "after", "right", "left").agg(F.count("*").alias("n"), first.alias("first")))
    side = lambda k, part: F.struct(F.lit(k).alias("side"), F.xxhash64(F.lit(k), "gram", part).alias("group"))
    dealt = classes.select("gram", "class", "n", "first", F.explode(F.array(side(0, "right"), side(1, "left"))).alias("d")).select("*", "d.*").drop("d")
    sizes = dealt.groupBy("group").agg(F.count("*").alias("members"), F.count_if(F.col("n") == 1).alias("alone")).where("members > 1 and alone > 0")
    wanted = dealt.join(sizes.drop("alone"), "group").select("first.doc_id", "first.text_hash", F.struct("group", "members", "side", "gram", "class", "n", "first.at").alias("x"))
    listed = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("x").alias("wanted"))
    texts = rows.alias("l").join(listed.alias("r"), F.expr(_SAME)).select("l.text", "r.wanted")
    found = texts.mapInArrow(_surroundings, FOUND)
    salt = F.when(F.col("members") > MEMBERS, F.pmod("class", F.lit(SALTS))).otherwise(0)
    met = cut_lineage(found.withColumn("salt", salt).repartition("group", "salt").sortWithinPartitions("group").mapInArrow(_met, MET))
    windows = met.where("window is not null")
    again = windows.groupBy("group", "offset", "window").agg(F.count("*").alias("times")).where("times > 1").select("group", "offset", "window")
    by_window = windows.where("n = 1").join(again, ["group", "offset", "window"]).select("gram", "class", F.col("offset").alias("before"), (LENGTH - F.col("offset")).alias("after"))
    reached = met.where("window is null").select("gram", "class", "before", "after").union(by_window)
    reached = reached.groupBy("gram", "class").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    reached = reached.union(classes.where("n > 1").select("gram", "class", "before", "after"))
    spans = anchors.select("doc_id", "text_hash", "at", "gram", "class").join(reached, ["gram", "class"])
    span = F.struct((F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("after")).alias("end"))
    return spans.select("doc_id", "text_hash", span.alias("span")).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))


def _kept(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of the text, and how many runs of bytes were removed."""
    if not spans:
        return text, 0
    steps = np.zeros(len(text) + 1, np.int64)
    np.add.at(steps, [s["first"] for s in spans], 1)
    np.add.at(steps, [s["end"] for s in spans], -1)
    gone = np.cumsum(steps[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_py().encode()
                left, runs = _kept(data, spans.as_py())
                rows.append((doc_id, len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(docs, id_col, text_col)
    joined = _keyed(docs, id_col, text_col).alias("l").join(spans.alias("r"), F.expr(_SAME), "left").select("l.doc_id", "l.text", "r.spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
