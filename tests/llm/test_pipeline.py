import json

import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cellseason.llm import queries
from tests.oracle import compare, connect

from .helpers import odd_documents
from .test_decontaminate import brute as contaminated
from .test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == docs.columns and len(kept) >= 0.98 * docs.count()
    assert {r.doc_id for r in docs.collect() if len(r.text) > 300} <= set(kept)

    want = {i for i, group, *_ in near(sorted(kept.items())) if i == group}
    second = stages["ngram_join"](spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in contaminated([(i, kept[i]) for i in want], items) if not r[5]}
    third = stages["benchmark_decontamination"](spark, second, SF)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean < want

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.n_tokens for r in last.collect()} == {i: len(tokenizer.encode(kept[i], add_special_tokens=False).ids) for i in clean}


def test_odd_rows_pass_all_stages(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "0L as n_chars", "id", "class")
    docs = docs.union(docs.selectExpr("doc_id", "text", "'en'", "source", "n_chars", "id", "class"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert json.loads(docs.schema.json())["fields"] and docs.count() < 23, name
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_every_query_is_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_oracles(spark):
    con = connect(SF)
    for name, sql in queries.ORACLES.items():
        assert compare(queries.QUERIES[name](spark, SF), con, sql) == ""
