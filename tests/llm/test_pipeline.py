"""The pipeline against a brute-force version of its stages, and the registered queries of the subpackage."""

import hashlib
import itertools
import re

import public_tokenizers as P
import sentencepiece

import __spark_entry__
import corpus_pipeline
from tablecare.llm import toxicity

from .conftest import prose
from .test_models import labelled
from .test_search import chunks_removed, classes, family


def write(spark, folder):
    rows, marks = labelled(300, seed=40)
    block = "\n".join(prose(600 + k, 9) for k in range(6))
    items = [(1, prose(1001, 30)), (2, prose(1002, 20))]
    rows += [(1000 + k, t) for k, t in enumerate(family(8, 120, 12, [0, 1, 2]))]
    rows += [(2000 + k, f"{prose(1200 + k, 9)}\n{block}\n{prose(1300 + k, 9)}") for k in range(8)]
    rows += [(3000, "x " + items[0][1] + " y"), (3001, ""), (3002, None), (3003, items[1][1][:-1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in marks], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, rows, items


def test_pipeline(spark, tmp_path):
    docs, rows, items = write(spark, str(tmp_path))
    machine = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, machine).collect() if r["predicted"]}
    assert bad
    left = chunks_removed([r for r in rows if r[0] not in bad])
    first = {i for i, _, c in classes(left, 5, 80) if i == c}
    left = [r for r in left if r[0] in first]
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    own = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    leaks = {d for (d, t), (_, s) in itertools.product(left, items) if len(own(s) & own(t)) >= 0.8 * len(own(s))}
    assert leaks
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in left:
        if i not in leaks:
            ids = library.encode(t)
            want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_stages_take_an_empty_table(spark, tmp_path):
    docs, _, _ = write(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs.limit(0), str(tmp_path))
        assert done.isEmpty() and done.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).isEmpty()


def test_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
