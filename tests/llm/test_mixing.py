import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from cellseason.llm.mixing import cycle_weights, mix, water_fill, words
from pyspark.sql import functions as F

from .helpers import clashing, no_documents, odd_documents


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, most=3):
    """Round by round, with whole numbers."""
    total, clamped = sum(sizes.values()), set()
    while True:
        share = total - sum(most * sizes[s] for s in clamped)
        free = sum(weights[s] for s in sizes if s not in clamped)
        more = {s for s in sizes if s not in clamped and weights[s] * share > most * sizes[s] * free}
        if not more:
            return {s: most * sizes[s] if s in clamped else weights[s] * share / free if free else 0.0 for s in sizes}
        clamped |= more


def brute(docs, seed=12):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = plain_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    out = []
    for s in sizes:
        whole = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        own = [(int(hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16), i, t) for i, t, x in docs if x == s]
        for _, i, t in sorted(own, key=lambda r: r[0]):
            n = size(t)
            out.append((i, n, sizes[s], target[s], (whole + (rest > 0 and before + n / 2 <= rest)) * n))
            before += n
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    line = lambda n: rng.choice([" ", "\t\n ", "\x0b"]).join(rng.choice(["a", "bé", "漢", "x y"]) for _ in range(n))
    docs = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "B", "é", "漢", "", None, "tiny"])
        if source != "tiny" or rng.random() < 0.1:
            docs.append((i, line(rng.choice([0, 1, 5, 30])), source))
    return docs + [(1000, None, "a"), (1001, "", "empty"), (1002, None, "none"), (1003, "w " * 900, "long"), (None, "no id", "a")]


def frame(spark, docs):
    return clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"))


def test_against_plain_rounds_and_prefixes(spark):
    docs = cases()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted((tuple(r) for r in mix(frame(spark, docs)).select(columns).collect()), key=repr)
    assert got == brute(docs)
    again = mix(frame(spark, docs).repartition(3)).select(columns)  # another layout, the same draws
    assert sorted((tuple(r) for r in again.collect()), key=repr) == got


def test_sources_come_near_their_targets_and_no_document_exceeds_its_cap(spark):
    got = mix(frame(spark, cases())).collect()
    source = {(i, size(t)): s for i, t, s in cases()}
    by_source = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r["size"] and r.taken == r.repeats * r["size"]
        by_source[source[r.doc_id, r["size"]]].append(r)
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows) / 2 + 1e-6
    assert abs(sum(rows[0].target for rows in by_source.values()) - sum(r["size"] for r in got)) < 1e-6


@pytest.mark.parametrize("sizes, weights, want", [
    ([10, 10, 10], [1, 1, 1], [10, 10, 10]), ([1, 100], [1, 1], [3, 98]), ([1, 2, 97], [3, 3, 1], [3, 6, 91]), ([0, 5], [1, 1], [0, 5]),
    ([1, 10, 100], [100, 10, 1], [3, 30, 78]), ([4, 4], [0, 1], [0, 8]), ([1, 9], [1, 0], [3, 0]), ([0, 0], [1, 2], [0, 0])])
def test_water_filling(spark, sizes, weights, want):
    sources = spark.createDataFrame([(str(i), s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight long")
    assert [r.target for r in water_fill(sources).orderBy("source").collect()] == want


def test_rows_alike_are_drawn_one_by_one(spark):
    docs = [(7, "one two three", "copies")] * 300 + [(i, "a b c d", "other") for i in range(100)] + [(9, "x " * 500, "big")]
    got = mix(frame(spark, docs)).collect()
    taken = Counter(r.repeats for r in got if r.source_size == 900)
    target = next(r.target for r in got if r.source_size == 900)
    assert abs(sum(k * n * 3 for k, n in taken.items()) - target) <= 1.5 and len(taken) <= 2


def test_cycle_weights_by_code_point_and_null_last(spark):
    sources = spark.createDataFrame([("b",), (None,), ("B",), ("é",), ("a",), ("a",), ("",)], "source string")
    assert {r.source: r.weight for r in cycle_weights(sources).collect()} == {"": 1, "B": 2, "a": 3, "b": 1, "é": 2, None: 3}


def test_own_weights_and_words(spark):
    docs = frame(spark, [(1, "a b", "x"), (2, "c d", "y"), (3, "e", "z")])
    own = spark.createDataFrame([("x", 1), ("y", 1)], "source string, weight long")
    assert {r.doc_id: r.target for r in mix(docs, own).collect()} == {1: 2.5, 2: 2.5, 3: 0.0}
    texts = ["", " \t\n\x0b\x0c\r", "a", " a\x0bb ", "a b c d", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [size(t) for t in texts]


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("source", F.lit(None).cast("string"))
    got = mix(docs).collect()
    assert len(got) == 11 and {r.target for r in got} == {27000.0 + 7 * 3 + 1 + 3 + 8} and all(r.taken == r["size"] for r in got)
    assert mix(no_documents(spark).withColumn("source", F.lit("s"))).collect() == []
