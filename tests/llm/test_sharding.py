from collections import Counter

import numpy as np
import pytest

from cellseason.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards, split_evenly

from .helpers import no_documents, odd_documents


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_exact_sizes_and_gapless_slots(spark, n):
    df = spark.range(n).withColumnRenamed("id", "doc_id").repartition(5)
    got = shuffle_into_shards(df, 8).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert [len(slots[s]) for s in range(8)] == split_evenly(n, 8)
    assert all(v == list(range(len(v))) for v in slots.values())


def test_order_is_random(spark):
    got = sorted((r.shard, r.slot, r.doc_id) for r in shuffle_into_shards(spark.range(4000).withColumnRenamed("id", "doc_id"), 8).collect())
    order = np.array([r[2] for r in got])
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.08
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.08
    by_shard = Counter((r[0], r[2] % 8) for r in got)
    assert sum((v - 62.5) ** 2 / 62.5 for v in by_shard.values()) < 110  # 49 degrees of freedom


def test_matrix_has_the_law_of_a_uniform_shuffle():
    rows, columns = [3, 4, 5], [2, 6, 4]
    draws = [communication_matrix(rows, columns, seed) for seed in range(4000)]
    for m in draws:
        assert [sum(line) for line in m] == rows and [sum(c) for c in zip(*m)] == columns
    mean = np.mean(draws, axis=0)
    assert np.allclose(mean, np.outer(rows, columns) / 12, atol=0.06)
    var = np.var([m[0][1] for m in draws])
    assert abs(var - 3 * (6 / 12) * (6 / 12) * (12 - 3) / 11) < 0.05


def test_beyond_the_generators_range():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 10**10, 2000
    got = [hypergeometric(rng, good, bad, n) for _ in range(400)]
    p = good / (good + bad)
    assert abs(np.mean(got) - n * p) < 4 * (n * p * (1 - p) / 400) ** 0.5
    assert 0.75 < np.var(got) / (n * p * (1 - p)) < 1.3


def test_odd_rows(spark):
    got = shuffle_into_shards(odd_documents(spark), 3, ("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd_documents(spark).collect())
    assert shuffle_into_shards(no_documents(spark)).collect() == []


def test_documents_arrive_whole(spark):
    from cellseason.llm.queries import op2_sharding

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "octet_length(text) + 1 as size", "crc32(text) as crc").collect()}
    got = op2_sharding(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all((r["size"], r.text_crc32) == (docs[r.doc_id]["size"], docs[r.doc_id].crc) for r in got)
