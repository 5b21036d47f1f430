import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cellseason.llm import lexical
from cellseason.llm.lexical import Best, pieces, search

from .helpers import clashing, no_documents, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            if not c:
                continue
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k):
    got = search(clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(items, "item_id long, text string")), k)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def cases(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "b", "É", "ß9", "don", "t", "x1", "漢字", "cat", "dog", "sun"])
    line = lambda n: rng.choice([" ", "-", ", ", "\n", "\x00"]).join(word() for _ in range(n))
    docs = [(i, line(rng.choice([0, 1, 2, 3, 40]))) for i in range(150)]
    docs += [(200 + i, docs[7][1] or "a cat") for i in range(20)] + [(3, "a cat"), (3, "a cat"), (None, "a cat"), (400, None), (401, "rare word"), (402, "cat " * 5000)]
    items = [(i, line(rng.choice([0, 1, 4, 9]))) for i in range(12)] + [(3, "cat dog"), (3, "cat dog"), (None, "rare"), (50, None), (51, "unseen"), (52, "!!")]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_against_brute_force(spark, k):
    docs, items = cases()
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_small_tiles_and_many_passes_change_nothing(spark, monkeypatch):
    docs, items = cases(6)
    for name, value in (("DOCS", 7), ("TERMS", 2), ("ITEMS", 3), ("ITEM_BYTES", 90), ("PIECE", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert len(lexical.passes(spark.createDataFrame(items, "item long, text string").distinct())) > 1
    assert run(spark, docs, items, 5) == brute(docs, items, 5)


def test_products_of_full_tiles_stay_exact():
    weights, width = [2**15 - 1] * lexical.TERMS, lexical.TERMS
    assert lexical.TOP_IMPACT * weights[0] * width < lexical.EXACT
    tile = lexical.item_tiles([list(range(width))], weights)[0]
    got = lexical.tile_scores(tile, np.arange(width), np.zeros(width, dtype=np.int64), np.full(width, lexical.TOP_IMPACT - 1), 1, width)
    assert got.tolist() == [[width * (2**15 - 1) * (lexical.TOP_IMPACT - 1)]]


def test_ties_at_the_edge_are_decided_by_id_whatever_the_order():
    import pyarrow as pa

    for order in (range(40), reversed(range(40))):
        best = Best(1, 3)
        for i in order:
            best.add(np.array([[5, 5]]), 0, pa.array([2 * i + 1, 2 * i]))
            best.cut()
        assert best.rows().column("id").to_pylist() == [0, 1, 2]


def test_pieces_are_whole_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 4)
    assert [t for p in pieces("Abc defghij, k\tÉé 12") for t in p] == ["abc".encode(), b"defghij", b"k", "Éé".encode(), b"12"]


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "12 34 seven")], "item_id long, text string")
    got = search(odd_documents(spark), items).collect()
    assert [(r.doc_id, r.rank) for r in got if r.item_id == 1] == [(5, 1)]
    assert [r.doc_id for r in sorted((r for r in got if r.item_id is None), key=lambda r: r.rank)] == [7, 1, 1, 8]
    assert search(no_documents(spark), items).collect() == [] and search(odd_documents(spark), items.limit(0)).collect() == []
