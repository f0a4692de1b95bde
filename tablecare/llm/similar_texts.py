"""Documents of nearly the same word shingles: grouped prefix join on Jaccard similarity.

A text's shingles, as 64-bit hashes, are put in one order for the whole table:
rare before frequent (by a table of frequency levels of fixed size, counted over
all texts), then by hash.  Two sets that similar must share one of the first
n - ceil(t n) + 1 shingles, the prefix.  Texts of equal sets are one node;
nodes of equal prefix and size are one group, and only groups are matched, on
prefix shingles that more than one text has, by size and place.  Matched groups
are sifted by parity sketches (a lower bound on the difference of any of their
members), expanded to nodes, sifted again and verified on the whole sets.

Large families don't make all their pairs: first every group of a shared
shingle is verified against one of them, the links found are closed to
components, and so again with others as long as that connects families; then
pairs of different components follow.  Shingles that the same groups share are
met once.  Nothing is capped; what is left out are pairs known to be connected.

Defined cases: texts without words, null or empty, have no shingles and link
with nothing; texts of fewer words than a shingle are one shingle; repeated
rows link with each other; null ids are not allowed to link and come out with a
null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.components import components
from tablecare.llm.frequency import frequency_levels, level_of
from tablecare.llm.texts import Words, id_and_text, mixed, shingles, slices
from tablecare.sources.session import cut_lineage

SIZE, PERCENT = 3, 90
#: Least numbers of texts for the frequency levels from 1 on; level 0 is certain to be in one text only.
LEVELS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384)
SKETCH = 8
#: Last shingles of a prefix, by which a pair of groups that meets at several is taken at one: families share these.
TRAILING = 6
#: Pairs left for each place left that call for another turn, and the share of the pairs before it that a turn must not leave to be followed by one.
CROWDED, STALLED = 2, 0.75


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    hashes, owner = shingles(Words(texts), size)
    order = np.lexsort([hashes, owner])
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield hashes[a:b]


def digest(own: np.ndarray) -> int:
    """64 bits that tell a set: its node."""
    return int(mixed(mixed(own + np.uint64(11)).sum(dtype=np.uint64)[None] + np.uint64(len(own)))[0].astype(np.int64))


def _prefixes(shared: Broadcast, size: int, percent: int):
    """A row for each text: its set's size and digest, how many shingles other texts may have, its group, those of its prefix and their places among them, a sketch."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = ["doc_id", "n", "known", "node", "grp", "shingles", "places", "sketch", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for doc_id, own in zip(piece.column("doc_id").to_pylist(), sets(piece.column("text"), size), strict=True):
                    n = len(own)
                    if not n:
                        rows.append((doc_id, 0, 0, None, None, [], [], []))
                        continue
                    level = level_of(levels, own)
                    length = n - (percent * n + 99) // 100 + 1
                    order = np.argsort(level, kind="stable")[:length]
                    prefix = own[order]
                    group = int(mixed(mixed(prefix + np.arange(length, dtype=np.uint64)).sum(dtype=np.uint64)[None] + np.uint64(n))[0].astype(np.int64))
                    alone = int((level == 0).sum())
                    known = np.arange(min(alone, length), length)
                    rows.append((doc_id, n, n - alone, digest(own), group, prefix[known].view(np.int64), (known - alone).astype(np.int32), _sketch(own)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), piece.column("tie")], names)

    return run, "doc_id long, n long, known long, node long, grp long, shingles array<long>, places array<int>, sketch array<long>, tie long"


def _sketch(own: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each of 64 * ``SKETCH`` bits."""
    odd = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                own = list(sets(piece.column("text"), size))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "own"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


#: Words of a group's sketches: bits that all its members have, then bits that any of them has.
_BITS = [f"{kind}{k}" for kind in ("all", "any") for k in range(SKETCH)]
_SPOT = ("n", "place", "known", *_BITS, "first", "trailing")


class Join:
    """The steps of one join; tables that are used again are written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.size, self.percent = size, percent
        self.rows = id_and_text(docs, id_col, text_col)
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(frequency_levels(self.rows, lambda texts: sets(texts, size), LEVELS))
        run, schema = _prefixes(shared, size, percent)
        every = cut_lineage(self.rows.withColumn("tie", F.xxhash64("text")).mapInArrow(run, schema))
        self.docs = every.select("doc_id", "n", "node", "tie")
        self.nodes = cut_lineage(every.where("n > 0 and doc_id is not null").dropDuplicates(["node"]))

    def _fits(self, a: str, b: str) -> str:
        """Whether sizes allow the similarity."""
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def _needed(self, a: str, b: str) -> str:
        """Shingles that two sets must share, as a fraction."""
        return f"{self.percent} * ({a} + {b}) / {100.0 + self.percent}"

    def _may_match(self) -> str:
        """Whether sizes, shingles that others may have, place of a shared one, and sketches allow the similarity.

        Two groups differ at least where all members of one have a bit that no member of the other has.
        """
        most = "least(known - place, known2 - place2) + least(place, place2)"
        apart = " + ".join(f"bit_count((all{k} & ~any{k}2) | (all{k}2 & ~any{k}))" for k in range(SKETCH))
        needed = self._needed("n", "n2")
        return f"{self._fits('n', 'n2')} and {most} >= {needed} - 1e-6 and n + n2 - ({apart}) >= 2 * ({needed}) - 1e-6"

    def matched(self) -> DataFrame:
        """Shared prefix shingles of groups, each with the first group that has it."""
        parts = F.first(F.struct("n", "known", "shingles", "places")).alias("g")
        bits = [made(F.col("sketch")[k]).alias(f"{kind}{k}") for kind, made in (("all", F.bit_and), ("any", F.bit_or)) for k in range(SKETCH)]
        groups = self.nodes.groupBy("grp").agg(parts, *bits)
        first = F.greatest(F.array_size("g.shingles") - TRAILING, F.lit(0))
        placed = F.explode(F.arrays_zip("g.shingles", "g.places")).alias("s")
        tokens = groups.select("grp", "g.n", "g.known", *_BITS, first.alias("first"), F.slice("g.shingles", first + 1, TRAILING).alias("trailing"), placed)
        tokens = tokens.select(F.col("s.shingles").alias("shingle"), F.col("s.places").alias("place"), "grp", "n", "known", *_BITS, "first", "trailing")
        several = tokens.groupBy("shingle").agg(F.count("*").alias("times"), F.min(F.struct("n", "grp", "place", "known", *_BITS)).alias("hub")).where("times > 1")
        return cut_lineage(tokens.join(several.select("shingle", "hub"), "shingle"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes (a < b) that are similar."""
        own = self.nodes.select("node", "n", "sketch")
        a = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        apart = " + ".join(f"bit_count(sa[{k}] ^ sb[{k}])" for k in range(SKETCH))
        sifted = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(a, "a").join(b, "b")
        sifted = sifted.where(self._fits("na", "nb")).where(f"na + nb - ({apart}) >= 2 * ({self._needed('na', 'nb')}) - 1e-6").select("a", "b")
        whole_a, whole_b = (self.sets.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
        both = sifted.join(whole_b, "b").join(whole_a, "a").select("a", "b", "own_a", "own_b")
        return cut_lineage(both.mapInArrow(_similar(self.percent), "a long, b long"))

    def links(self) -> DataFrame:
        """Links (a, b) between nodes that connect all similar ones."""
        matched = self.matched()
        members = self.nodes.select("grp", "node")
        heads = members.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("members"))
        crowded = heads.where("members > 1")
        used = matched.select("grp").union(crowded.select("grp")).distinct()
        wanted = self.nodes.join(used, "grp", "left_semi").select("doc_id", "node")
        texts = self.rows.join(wanted.select("doc_id"), "doc_id", "left_semi")
        self.sets = cut_lineage(texts.mapInArrow(_whole_sets(self.size), "node long, own binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))

        hub = {"hub": "hub.grp", **{f"{c}2": f"hub.{c}" for c in ("n", "place", "known", *_BITS)}}
        pairs = matched.select("grp", *_SPOT, *[F.col(v).alias(k) for k, v in hub.items()])
        pairs = pairs.where("grp <> hub").where(self._may_match()).select("grp", "hub").distinct()
        with_heads = pairs.join(heads.select("grp", "head"), "grp").join(heads.select(F.col("grp").alias("hub"), F.col("head").alias("hub_head")), "hub")
        to_hub = with_heads.select("grp", F.col("hub_head").alias("a")).union(with_heads.select(F.col("hub").alias("grp"), F.col("head").alias("a")))
        inside = crowded.select("grp", F.col("head").alias("a"))
        first = self.verified(to_hub.union(inside).join(members, "grp").select("a", F.col("node").alias("b")))
        links, known = first, cut_lineage(components(first))

        before, turn = float("inf"), 0
        while True:
            placed = cut_lineage(self.nodes.select("grp", "node").join(known, "node", "left").withColumn("c", F.coalesce("component", "node")))
            left = self.unconnected(matched, placed)
            # families that the last turn connected go on by one of them a shingle; what it didn't connect meets pair by pair
            if self.pairs <= CROWDED * self.spots or self.pairs > STALLED * before:
                break
            found = self.verified(self._to_one(left, placed, turn))
            links = links.union(found)
            known = cut_lineage(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)))
            before, turn = self.pairs, turn + 1

        other = left.select("shingle", *[F.col(x).alias(f"{x}2") for x in ("grp", "c", *_SPOT)])
        # a pair that shares a later one of both trailing shingles is met there
        rest = lambda k: f"slice(trailing{k}, greatest(place{k} + 2 - first{k}, 1), {TRAILING})"
        once = f"not arrays_overlap({rest('')}, {rest('2')})"
        across = left.join(other, "shingle").where("grp < grp2 and c <> c2").where(self._may_match()).where(once)
        across = across.select("grp", "c", "grp2", "c2").distinct()
        of = placed.select("grp", "c", "node")
        second = across.join(of, ["grp", "c"]).withColumnRenamed("node", "a").join(of.select(F.col("grp").alias("grp2"), F.col("c").alias("c2"), F.col("node").alias("b")), ["grp2", "c2"])
        # and within groups whose nodes are not yet connected
        split = placed.groupBy("grp").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("grp")
        torn = placed.join(split, "grp", "left_semi").select("grp", "c", "node")
        within = torn.join(torn.select("grp", F.col("c").alias("c2"), F.col("node").alias("b")), "grp").where("c < c2").select(F.col("node").alias("a"), "b")
        return links.union(self.verified(second.select("a", "b").union(within)))

    def unconnected(self, matched: DataFrame, placed: DataFrame) -> DataFrame:
        """Shared shingles of groups as their components see them, where components differ.

        Of shingles that the same have, the last is enough: it is the last that any two of them share.
        ``spots`` and ``pairs`` tell how many rows are left and how many pairs of different components they make.
        """
        groups = placed.select("grp", "c").distinct()
        marks = [F.bit_xor(F.xxhash64("grp", "c", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
        own = matched.select("shingle", "grp", "place").join(groups, "grp").groupBy("shingle", "c").agg(F.count("*").alias("k"), F.min(F.struct("grp", "place")).alias("at"), *marks)
        lists = own.groupBy("shingle").agg(F.sum("k").alias("spots"), F.sum(F.col("k") * F.col("k")).alias("inside"), F.min("at").alias("at"), *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in (0, 1)], F.count("*").alias("several"))
        last = lists.where("several > 1").groupBy("spots", "inside", "x0", "x1").agg(F.max_by("shingle", "at.place").alias("shingle"))
        last = cut_lineage(last.select("shingle", "spots", ((F.col("spots") * F.col("spots") - F.col("inside")) / 2).alias("pairs")))
        self.spots, self.pairs = (x or 0 for x in last.agg(F.sum("spots"), F.sum("pairs")).first())
        return matched.join(last.select("shingle"), "shingle", "left_semi").select("shingle", "grp", *_SPOT).join(groups, "grp")

    def _to_one(self, left: DataFrame, placed: DataFrame, turn: int) -> DataFrame:
        """Pairs of nodes (a, b): of each group at a shingle one, with one of a group there that another turn chooses otherwise."""
        own = ("grp", "c", "n", "place", "known", *_BITS)
        hub = left.groupBy("shingle").agg(F.min_by(F.struct(*own), F.xxhash64("grp", "c", F.lit(turn))).alias("hub"))
        met = left.join(hub, "shingle").select("grp", "c", *_SPOT, *[F.col(f"hub.{x}").alias(f"{x}2") for x in own])
        met = met.where("grp <> grp2 and c <> c2").where(self._may_match()).select("grp", "c", "grp2", "c2").distinct()
        heads = placed.groupBy("grp", "c").agg(F.min("node").alias("head"))
        one = heads.withColumnRenamed("head", "a")
        return met.join(one, ["grp", "c"]).join(heads.toDF("grp2", "c2", "b"), ["grp2", "c2"]).select("a", "b")

    def classes(self) -> DataFrame:
        """doc_id, n, tie (hash of the text) and component c of every row that can link."""
        found = cut_lineage(components(self.links()))
        return self.docs.where("n > 0 and doc_id is not null").join(found, "node", "left").select("doc_id", "n", "tie", F.coalesce("component", "node").alias("c"))

    def result(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        linked = self.classes()
        least = linked.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        apart = self.docs.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return linked.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(apart)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links, its own included) of every row."""
    return Join(docs, id_col, text_col, size, percent).result()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row, all columns, of each component: that of the smallest id, among its texts that of the smallest hash.

    Rows are told apart by id and text, so a text stays although another one of
    its id goes; of rows equal in both, one stays.  Rows that link with nothing,
    without words or id, all stay.
    """
    linked = cut_lineage(Join(docs, id_col, text_col, size, percent).classes())
    first = linked.groupBy("c").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    rows = linked.groupBy("doc_id", "tie").agg(F.first("c").alias("c"), F.count("*").alias("times")).join(first, "c")
    fate = F.when(F.struct("doc_id", "tie") != F.col("first"), "goes").when(F.col("times") > 1, "repeated")
    marked = rows.select(F.col("doc_id").alias("k_id"), F.col("tie").alias("k_tie"), fate.alias("fate")).where("fate is not null")
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("d_id"), F.xxhash64(text).alias("d_tie"))
    judged = whole.join(marked, (F.col("d_id") == F.col("k_id")) & (F.col("d_tie") == F.col("k_tie")), "left").select("row", "d_id", "d_tie", "fate")
    kept = judged.where("fate is null").union(judged.where("fate = 'repeated'").dropDuplicates(["d_id", "d_tie"]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
