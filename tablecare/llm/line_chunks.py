"""Repeated multi-line chunks, removed from all texts but the first.

A rolling hash runs over the lines of a text, two at a time, and bounds a chunk
by what two lines say and nothing else, so text put in or taken out elsewhere
shifts no boundary.  Chunks have two lines and overlap by one: chunks cut only
where such a hash meets a divisor have passages of two to four lines nowhere
whole, and longer ones without their ends.  A passage of several lines that
stands anywhere else is covered from its first line to its last, whatever lies
around it.  Lines of chunks that occur more than once go, after a comparison of
their bytes, from all places but the first, in order of doc_id, a hash of the
text, and place.  The first place of any line always stays.

DataFrame operations only.  Chunks travel as hashes; texts move once to compare
candidate chunks and once to be rebuilt.

Defined cases: a null text is empty, and an empty text one empty line; rows
equal in doc_id and text are one document (neither is removed for the other);
null doc_ids come first; a line alone is kept, however often it occurs, and so
are chunks of blank lines only; chunks of equal hashes and different bytes
would be kept; a table without rows gives none.  Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.sources.session import cut_lineage

#: Characters of a blank line.
BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _blank(line: Column) -> Column:
    return F.translate(line, BLANK, "") == ""


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The other columns as one struct beside the key (id, hash of text) and the text, which so travels once."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    others = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    return docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), docs[f"`{id_col}`"].alias("k_id"), F.xxhash64(text).alias("k_tie"), text.alias("k_text"))


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_tie, place (from 0) and the two hashes of every chunk that isn't blank."""
    lines = _keyed(docs, id_col, text_col).select("k_id", "k_tie", _lines(F.col("k_text")).alias("lines"))
    both = F.arrays_zip(F.col("lines").alias("a"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("b"))
    each = lines.select("k_id", "k_tie", F.posexplode(both).alias("place", "x")).where(F.col("x.b").isNotNull() & ~(_blank(F.col("x.a")) & _blank(F.col("x.b"))))
    return each.select("k_id", "k_tie", "place", F.xxhash64("x.a", "x.b").alias("one"), F.xxhash64("x.b", "x.a").alias("two"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_tie and place of every repeated chunk other than the first of its kind."""
    chunks, kind = chunk_table(docs, id_col, text_col), ["one", "two"]
    spot = F.xxhash64("k_id", "k_tie", "place")
    kinds = chunks.groupBy(*kind).agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low < high").select(*kind)
    found = cut_lineage(chunks.join(kinds, kind, "left_semi"))
    at = F.struct("k_id", "k_tie", "place")
    first = found.groupBy(*kind).agg(F.min(at).alias("kept"))
    unequal = _unequal(docs, found, id_col, text_col)
    return found.join(first, kind).where(at != F.col("kept")).join(unequal, kind, "left_anti").select("k_id", "k_tie", "place")


def _unequal(docs: DataFrame, chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes that chunks of different bytes share."""
    places = chunks.groupBy("k_id", "k_tie").agg(F.collect_set(F.struct("place", "one", "two")).alias("chunks"))
    texts = _keyed(docs, id_col, text_col).select("k_id", "k_tie", "k_text").alias("d").join(places.alias("p"), F.expr("d.k_id <=> p.k_id and d.k_tie = p.k_tie"))
    each = texts.select(_lines(F.col("k_text")).alias("lines"), "chunks").select("lines", F.explode("chunks").alias("c"))
    whole = each.select("c.one", "c.two", F.concat_ws("\n", F.get("lines", F.col("c.place")), F.get("lines", F.col("c.place") + 1)).alias("bytes"))
    return whole.distinct().groupBy("one", "two").count().where("count > 1").select("one", "two")


def _flags(chunks: DataFrame) -> DataFrame:
    """k_id, k_tie and, from line 0 to the last chunk, whether a chunk to be removed begins there."""
    places = chunks.groupBy("k_id", "k_tie").agg(F.array_sort(F.collect_set("place")).alias("places"))
    gaps = F.arrays_zip(F.col("places").alias("here"), F.concat(F.array(F.lit(-1)), F.col("places")).alias("before"))
    flags = F.transform(F.filter(gaps, lambda g: g["here"].isNotNull()), lambda g: F.array_append(F.array_repeat(F.lit(False), g["here"] - g["before"] - 1), F.lit(True)))
    return places.select("k_id", "k_tie", F.flatten(flags).alias("flags"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """All rows and columns with repeated chunks taken out of the text; with ``counts`` also n_lines and n_removed."""
    flags = _flags(repeated_chunks(docs, id_col, text_col))
    both = _keyed(docs, id_col, text_col).alias("d").join(flags.alias("m"), F.expr("d.k_id <=> m.k_id and d.k_tie = m.k_tie"), "left")
    marked = F.arrays_zip(_lines(F.col("k_text")).alias("line"), F.col("flags").alias("begins"), F.concat(F.array(F.lit(False)), F.col("flags")).alias("ends"))
    kept = F.transform(F.filter(marked, lambda s: ~(F.coalesce(s["begins"], F.lit(False)) | F.coalesce(s["ends"], F.lit(False)))), lambda s: s["line"])
    both = both.select("row", "k_text", F.when(F.col("flags").isNotNull(), kept).alias("k_kept"))
    text = F.coalesce(F.array_join("k_kept", "\n"), F.col("k_text"))
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        n_lines = F.array_size(_lines(F.col("k_text")))
        columns += [n_lines.cast("long").alias("n_lines"), F.coalesce(n_lines - F.array_size("k_kept"), F.lit(0)).cast("long").alias("n_removed")]
    return both.select(*columns)


#: The same rows in SQL, for documents with one row an id.
SQL = """
with lines as (
    select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line
    from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as u(i)
), paired as (
    select *, lead(line) over (partition by doc_id order by i) as following from lines
), chunks as (
    select * from paired where following is not null
        and translate(line || following, ' ' || chr(9) || chr(13), '') <> ''
), later as (
    select doc_id, i from (select *, row_number() over (partition by line, following order by doc_id, i) as nth from chunks) where nth > 1
), gone as (
    select doc_id, i from later union select doc_id, i + 1 from later
)
select l.doc_id, count(*) as n_lines, count(g.doc_id) as n_removed,
    md5(coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.doc_id is null), '')) as kept_md5
from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i
group by l.doc_id
"""
