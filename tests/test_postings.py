import os
import random
import re

import pytest

from cellseason.operators import text as kit
from cellseason.sources import postings

from .conftest import rows

SCHEMA = "doc_id bigint, text string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def brute(texts, query):
    counts = {i: (t or "").lower().count(query.lower()) for i, t in texts.items()}
    return {i: n for i, n in counts.items() if n}


def found(spark, path, texts, query, top=100):
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    return {r["doc_id"]: r["occurrences"] for r in postings.search_postings(spark, path, df, query, top).collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["criquet", "Criquets", "aaaa", "NDVI", "été", "l'eau", "x_1", "grégaire", "of", "a", "données-ndvi"]
    made = {i: " ".join(rng.choices(words, k=rng.randint(0, 60))) for i in range(40)}
    return made | {100: None, 101: "", 102: "--- !!", 103: "aaaaaaa aa", 104: "criquet " * 3000}


def test_counts_and_searches_against_the_texts(spark, tmp_path, texts):
    path = str(tmp_path / "i")
    postings.update_postings(spark, spark.createDataFrame(list(texts.items()), SCHEMA), path)
    for q in ["criquet", "aa", "a", "NDVI", "ÉTÉ", "x_", "l'eau", "criquet été", "nothing", "!!", "s-n"]:
        assert found(spark, path, texts, q) == brute(texts, q), q
    got = {(r["query"], r["doc_id"]): r["occurrences"] for r in postings.string_counts(spark, path, ["quet", "ndvi"]).collect()}
    assert got == {(q, i): n for q in ["quet", "ndvi"] for i, n in brute(texts, q).items()}
    with pytest.raises(ValueError):
        postings.string_counts(spark, path, ["l'eau"])


def test_ranks_and_previews_are_those_of_the_scan(spark, tmp_path, texts):
    path = str(tmp_path / "i")
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    postings.update_postings(spark, df, path)
    scan = kit.search_sections(df.selectExpr("doc_id", "text AS content", "1 AS section_no"), "ndvi", 7).select("doc_id", "occurrences", "preview")
    assert rows(postings.search_postings(spark, path, df, "ndvi", 7), "doc_id") == rows(scan, "doc_id")


def test_positions_are_word_numbers(spark):
    df = spark.createDataFrame([(1, "Un deux, un.\nTROIS un")], SCHEMA)
    got = {r["term"]: list(r["positions"]) for r in postings.postings_of(df).collect()}
    assert got == {"un": [0, 2, 4], "deux": [1], "trois": [3]}


def test_words_are_grouped_without_an_exchange(spark, texts):
    table = spark.createDataFrame(list(texts.items()), SCHEMA)
    made = postings.postings_of(table)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in texts.items():
        for at, w in enumerate(re.findall(r"\w+", (t or "").lower())):
            want.setdefault((w, i), []).append(at)
    assert {(r["term"], r["doc_id"]): r["positions"] for r in made.collect()} == want


def test_updates_replace_documents_and_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "i")
    texts = {i: f"common word{i}" for i in range(60)}
    postings.update_postings(spark, spark.createDataFrame(list(texts.items()), SCHEMA), path)
    before = files(f"{path}/postings")
    change = {3: "other common", 7: None, 99: "brandnew"}
    touched = postings.update_postings(spark, spark.createDataFrame(list(change.items()), SCHEMA), path)
    after = files(f"{path}/postings")
    changed = {p for p in before if after.get(p) != before[p]} | set(after) - set(before)
    assert touched and len(touched) <= 5
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in changed} == set(touched)
    texts |= change
    for q in ["common", "word3", "word7", "other", "brandnew"]:
        assert found(spark, path, texts, q) == brute(texts, q), q
    # the same update once more changes no answer
    postings.update_postings(spark, spark.createDataFrame(list(change.items()), SCHEMA), path)
    table = spark.read.parquet(f"{path}/postings").filter("term is not null")
    assert table.count() == table.select("term", "doc_id").distinct().count() == sum(len((t or "").split()) for t in texts.values())


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "i")
    texts = {i: f"alpha{i} beta" for i in range(50)}
    postings.update_postings(spark, spark.createDataFrame(list(texts.items()), SCHEMA), path)
    bucket = postings.matching_terms(spark, path, ["beta"]).first()["bucket"]
    plan = postings.string_counts(spark, path, ["beta"])._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert any(re.search(rf"bucket#\d+ (IN \({bucket}\)|= {bucket}\b)", f) for f in filters), filters


def test_no_documents_and_no_words(spark, tmp_path):
    path = str(tmp_path / "i")
    postings.update_postings(spark, spark.createDataFrame([(1, "a b c"), (2, "")], SCHEMA), path)
    assert postings.update_postings(spark, spark.createDataFrame([], SCHEMA), path) == []
    assert found(spark, path, {1: "a b c", 2: ""}, "b") == {1: 1}
