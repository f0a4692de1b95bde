"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm import alignment, collision_search, containment, line_chunks, pieces, repeats, similar_texts, suffix_tree, token_counts, token_files, top_products, toxicity, whitening
from tablecare.sources.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digests(spark, path)


@query("op4_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_suffix_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_line_chunks", line_chunks.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_chunks.remove_repeats(table(spark, sf_dir, "documents"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query("op7_containment", containment.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containment.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


_COMPONENTS = """
with whole as (
    select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) as score
    from whole q join whole c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, cast(score as bigint) as score from scored)
where rank <= 5
"""


@query("op2_top_products", _COMPONENTS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_similar_texts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts.similar_components(table(spark, sf_dir, "documents"))


@query("op8_repeats")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 4)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_collisions")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
