"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles.  A partition's bounds say
how many of an item's shingles, those of smallest hash, make up its sketch:
a text with at least ``SHARE`` of an item's shingles misses at most the others,
so with one more min-hash than those the sketch and the text must meet.  Texts
are long and items short; therefore only items are sketched, and a text is
looked up with all of its shingles.  No leak is lost, whatever the text's size.
Candidates are verified by counting shared shingles exactly.

A shingle is five successive words (runs of letters and digits of the
lower-cased text); an item of fewer words is one shingle of that length.

DataFrame operations only.  The sketch table is written before it is joined,
so Spark knows its size and broadcasts it only below its threshold.

Defined cases: null or empty texts, and items without words, match nothing;
rows equal in doc_id and text are one document; equal items are each found; an
empty table on either side gives no rows.  Other columns pass through
``drop_leaks``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.sources.session import cut_lineage

WORDS, SHARE_PERCENT = 5, 80


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns worked out once a row; a generator keeps them from being put into each use of theirs."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select("*", F.explode(F.array(made)).alias("made")).select(*[F.col(c) for c in rows.columns], "made.*")


def _runs(words: Column, size: int, make) -> Column:
    """``make`` of each run of ``size`` words, in order."""
    n = F.array_size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: make(size, [F.element_at(words, i + k) for k in range(size)])))


def _hashed(size: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(size), *words)


def _spelled(size: int, words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _shingles(rows: DataFrame, sizes: list[int], make=_hashed) -> DataFrame:
    """One row for each shingle of each text, as ``shingle``."""
    parts = [F.coalesce(_runs(F.col("words"), s, make), F.array()) for s in sizes]
    both = parts[0] if len(parts) == 1 else F.concat(*parts)
    return _held(rows, words=_words(F.col("k_text"))).select(*[c for c in rows.columns if c != "k_text"], F.explode(both).alias("shingle"))


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, shingle, n) of all items' distinct shingles, and of those in the sketches."""
    rows = _held(items.select(items[f"`{id_col}`"].alias("item_id"), items[f"`{text_col}`"].alias("k_text")), words=_words(F.col("k_text")))
    own = F.lit(None)
    for size in range(WORDS, 0, -1):
        enough = F.array_size("words") >= size if size == WORDS else F.array_size("words") == size
        own = F.when(enough, F.array_distinct(_runs(F.col("words"), size, lambda n, w: F.struct(F.lit(n).alias("size"), _hashed(n, w).alias("hash"), _spelled(n, w).alias("spelled"))))).otherwise(own)
    found = _held(rows, shingles=own).select("item_id", F.array_size("shingles").alias("n"), F.explode("shingles").alias("s")).select("item_id", "n", "s.*")
    # partitions: sizes between two powers of two; n less the shingles that a text must have, and one
    found = found.withColumn("low", F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    missed = F.col("n") - F.ceil(F.col("n") * SHARE_PERCENT / 100)
    found = cut_lineage(found.withColumn("kept", missed + 1))
    order = F.row_number().over(Window.partitionBy("item_id", "low").orderBy("hash", "spelled"))
    return found, cut_lineage(found.withColumn("nth", order).where("nth <= kept").select("item_id", "hash", "size", "low", "n"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[f"`{text_col}`"]
    return docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k_tie"), text.alias("k_text"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, k_tie (hash of its text), item_id, n_shared and n_item of every item that a document contains."""
    every, sketch = sketches(items, item_id, item_text)
    sizes = sorted(r[0] for r in every.select("size").distinct().collect()) or [WORDS]  # at most ``WORDS`` rows
    keyed = _keyed(docs, id_col, text_col)
    met = _shingles(keyed, sizes).join(sketch.select("item_id", F.col("hash").alias("shingle")), "shingle")
    pairs = cut_lineage(met.select("doc_id", "k_tie", "item_id").distinct())
    texts = pairs.select(F.col("doc_id").alias("p_id"), F.col("k_tie").alias("p_tie")).distinct()
    chosen = keyed.join(texts, F.expr("doc_id <=> p_id and k_tie = p_tie"), "left_semi").dropDuplicates(["doc_id", "k_tie"])
    own = _shingles(chosen, sizes, _spelled).distinct()
    wanted = pairs.join(every.select("item_id", "n", F.col("spelled").alias("shingle")), "item_id").alias("w")
    shared = own.alias("o").join(wanted, F.expr("o.doc_id <=> w.doc_id and o.k_tie = w.k_tie and o.shingle = w.shingle"))
    counts = shared.groupBy(F.col("o.doc_id").alias("doc_id"), F.col("o.k_tie").alias("k_tie"), "item_id").agg(F.count("*").alias("n_shared"), F.first("n").cast("long").alias("n_item"))
    return counts.where(F.col("n_shared") * 100 >= F.col("n_item") * SHARE_PERCENT)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns, that contain no item."""
    leaks = cut_lineage(find_leaks(docs, items, id_col, text_col, item_id, item_text).select(F.col("doc_id").alias("k_id"), "k_tie").distinct())
    tie = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("d_id"), tie.alias("d_tie"))
    kept = kept.join(leaks, F.expr("d_id <=> k_id and d_tie = k_tie"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_SQL_WORDS = "[x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+') if x <> '']"

#: The same pairs in SQL, for items of five words or more.
SQL = rf"""
with item_words as (select item_id, {_SQL_WORDS} as w from benchmark),
item_shingles as (
    select distinct item_id, array_to_string(w[i:i + {WORDS - 1}], ' ') as s
    from item_words, unnest(range(1, len(w) - {WORDS - 2})) as u(i) where len(w) >= {WORDS}
),
sizes as (select item_id, count(*) as n_item from item_shingles group by item_id),
doc_words as (select doc_id, {_SQL_WORDS} as w from documents),
doc_shingles as (
    select distinct doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') as s
    from doc_words, unnest(range(1, len(w) - {WORDS - 2})) as u(i) where len(w) >= {WORDS}
),
shared as (select doc_id, item_id, count(*) as n_shared from doc_shingles join item_shingles using (s) group by all)
select doc_id, item_id, n_shared, n_item from shared join sizes using (item_id) where n_shared * 100 >= n_item * {SHARE_PERCENT}
"""
