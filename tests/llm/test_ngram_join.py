import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellseason.llm import ngram_join
from cellseason.llm.ngram_join import Forest, WordHashes, found_share, keep_one_of_each, least_members, linked_pairs, near_groups, prefix_length, shingles

from .helpers import clashing, no_documents, odd_documents


def grams(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(id, class_id, copy_id, n_copies, n_links) of unique ids, all pairs compared."""
    sets = {i: grams(t) for i, t in rows}
    same = defaultdict(list)
    for i, s in sets.items():
        same[s].append(i)
    links, up = Counter(), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                u, v = sorted((top(a), top(b)))
                up[v] = u
    return sorted((i, top(i), min(same[s]) if s else i, len(same[s]) if s else 1, links[i]) for i, s in sets.items())


def families(rng, n, size, changes):
    rows = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 3000)}"
            rows.append(" ".join(w))
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [3, 200])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = families(random.Random(block), 40, 6, 4) + [(9000, "short text"), (9001, "Short  TEXT"), (9002, ""), (9003, None)]
    got = near_groups(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(tuple(r) for r in near_groups(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(160)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    assert sorted(tuple(r) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_odd_rows(spark):
    got = {}
    for r in near_groups(odd_documents(spark)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got[1] == [(1, 1, 3, 2)] * 2 and got[8] == [(1, 1, 3, 2)]
    assert got[2] == [(2, 2, 1, 0)] and got[3] == [(3, 3, 1, 0)] and got[None] == [(None, None, 1, 0)] * 2
    assert near_groups(no_documents(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = keep_one_of_each(docs, near_groups(docs, hashes=True))
    assert kept.columns == docs.columns or set(kept.columns) == set(docs.columns)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, None, None, 5, 6, 7], key=repr)


def test_prefixes_are_shortened_to_the_recall():
    depth = prefix_length()
    assert found_share(0.8, depth, ngram_join.TREES) >= ngram_join.RECALL > found_share(0.8, depth + 1, ngram_join.TREES)
    rng = np.random.default_rng(1)
    forest, hits = Forest(24, depth), 0
    for _ in range(300):
        words = [str(x) for x in rng.integers(0, 10**9, 400)]
        a = shingles(" ".join(words), WordHashes())
        b = np.concatenate((a[:-44], rng.integers(0, 2**63, 44).astype(np.uint64)))  # Jaccard 0.8
        x, y = (np.frombuffer(forest.label(s), ">u2").reshape(24, depth) for s in (a, b))
        hits += bool((x == y).all(axis=1).any())
    assert hits >= 298


def test_exact_threshold():
    sets = [np.arange(0, 8), np.arange(0, 10), np.arange(1, 11)]
    pairs = {tuple(p) for p in zip(*map(list, linked_pairs([s.astype(np.uint64) for s in sets], 0.8)))}
    assert pairs == {(0, 1), (1, 2)}  # 8/10, 9/11; not 7/11


def test_least_members_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.u: r.root for r in least_members(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}


def test_all_ids_null(spark):
    rows = [(None, f"one two three four five six {i % 5}") for i in range(60)] + [(None, "a b c d e f g")] * 40
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.n_copies for r in got) == {12: 60, 40: 40} and Counter(r.n_links for r in got) == {11: 60, 39: 40}


def test_rows_of_one_id_and_unlike_texts_stay_by_themselves(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = clashing(spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, b + " more"), (None, c), (7, None), (7, ""), (8, None)], "doc_id long, text string"))
    got = ngram_join.keep_one_of_each(docs, ngram_join.near_groups(docs, hashes=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, a), (5, b), (None, c), (7, None), (7, ""), (8, None)], key=repr)
