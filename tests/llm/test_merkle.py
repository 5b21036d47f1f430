import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cellseason.llm import merkle
from cellseason.llm.merkle import fold, leaf, path_digest, prove

from .helpers import clashing, no_documents, odd_documents

FIELDS = ("doc_id", "source", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Root, and of each leaf its siblings level by level (left, right)."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, j in enumerate(at):
            run = nodes[j - j % 3 : j - j % 3 + 3]
            ways[i].append(("".join(run[: j % 3]), "".join(run[j % 3 + 1 :])))
            at[i] = j // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in order:
        leaves = sorted((r[0] is not None, r[0] or 0, plain_leaf(*r)) for r in groups[s])
        inner[s] = leaves, *plain_tree([x[2] for x in leaves])
    root, above = plain_tree([inner[s][1] for s in order])
    return [(x[1] if x[0] else None, x[2], inner[s][1], root, tuple(way + above[i])) for i, s in enumerate(order) for x, way in zip(inner[s][0], inner[s][2])]


def run(spark, rows):
    got = prove(clashing(spark.createDataFrame(rows, "doc_id long, source string, text string")), FIELDS)
    return got, [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in got.collect()]


def cases(sizes):
    rng = random.Random(4)
    rows = [(rng.randrange(10**6), source, rng.choice(["", "a\nb", "é漢", None]) and f"{source} {i}\n") for source, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 4}, {None: 1, "": 10, "B": 28, "b": 9, "é": 27}, {"hot": 700, None: 81, "x": 82, "y": 243, "z": 1}])
def test_against_a_plain_tree(spark, sizes, monkeypatch):
    rows = cases(sizes)
    want = brute(rows)
    assert sorted(run(spark, rows)[1], key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(merkle, "LEVELS", 2)  # more stored levels, smaller subtrees
    monkeypatch.setattr(merkle, "SUBTREE", 9)
    assert sorted(run(spark, rows)[1], key=repr) == sorted(want, key=repr)


def test_many_groups_make_a_deep_upper_tree(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SUBTREE", 3)
    rows = cases({f"s{i}": i % 5 + 1 for i in range(60)})
    assert sorted(run(spark, rows)[1], key=repr) == sorted(brute(rows), key=repr)


def test_only_every_few_levels_are_stored(spark, tmp_path):
    rows = cases({"a": 400, "b": 5})
    prove(spark.createDataFrame(rows, "doc_id long, source string, text string"), FIELDS, folder=str(tmp_path / "m")).count()
    stored = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "m" / "trees").iterdir()}
    assert stored == {"level=0": 405, "level=5": 3, "level=10": 1}


def test_folding_finds_tampering(spark):
    rows = [(i, "s", f"text {i}\nmore") for i in range(50)] + [(99, "t", "alone\n")]
    changed = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = prove(spark.createDataFrame(rows, "doc_id long, source string, text string"), FIELDS, shown=leaf(F.col("doc_id"), F.col("source"), changed))
    got = got.select("doc_id", "leaf", "shown", (fold(F.col("shown"), F.col("path")) == F.col("root")).alias("good"), path_digest(F.col("path")).alias("digest"), "path").collect()
    assert all(r.good == (r.doc_id % 2 == 1) == (r.leaf == r.shown) for r in got)
    assert all(r.digest == h(*[s.left + s.right for s in r.path]) for r in got)


def test_rows_alike_are_leaves_of_their_own(spark):
    rows = [(1, "s", "same")] * 40 + [(None, None, None)] * 7
    got = run(spark, rows)[1]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("source", F.lit(None).cast("string"))
    got = prove(docs, FIELDS).collect()
    rows = [(r.doc_id, None, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.leaf, r.root) for r in got if r.doc_id is not None) == sorted((i, x, root) for i, x, _, root, _ in brute(rows) if i is not None)
    assert prove(no_documents(spark).withColumn("source", F.lit("s")), FIELDS).collect() == []
