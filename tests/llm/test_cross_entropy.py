import math
from collections import Counter

import numpy as np
import pytest

from cellseason.llm import cross_entropy
from cellseason.llm.cross_entropy import ADDED, PAIR_SHARE, counts_of_bytes, counts_to_bytes, patch, patched, score

from .helpers import clashing, no_documents, odd_documents


def plain(rows, good):
    """Counted by strings; each document is scored by all others."""
    docs = [(i, (t or "").lower().split()) for i, t in rows]
    count = lambda d: (Counter(d), Counter([None, *d[:-1]] if d else []), Counter(zip([None, *d], d)))
    vocabulary, models = len({w for _, d in docs for w in d}), []
    for ids in (good, None):
        every = (Counter(), Counter(), Counter())
        for i, d in docs:
            for total, own in zip(every, count(d) if ids is None or i in ids else ()):
                total.update(own)
        # a word's context count is how often it comes, also at the end of a document
        models.append((ids, every[0], every[0] + Counter({None: every[1][None]}), every[2]))
    out = []
    for i, d in docs:
        loss = []
        for ids, word, context, pair in models:
            own = count(d) if d and (ids is None or i in ids) else (Counter(),) * 3
            own = own[0], own[0] + Counter({None: own[1][None]}), own[2]
            n, total = sum(word.values()) - sum(own[0].values()), 0
            for b, w in zip([None, *d], d):
                p = (word[w] - own[0][w] + ADDED) / (n + ADDED * vocabulary)
                c = context[b] - own[1][b]
                total -= math.log(PAIR_SHARE * (pair[b, w] - own[2][b, w]) / c + (1 - PAIR_SHARE) * p if c else p)
            loss.append(total / len(d) if d else None)
        out.append((i, len(d), *loss, loss[0] - loss[1] if d else None))
    return out


def close(got, want):
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2] or 0))
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:2] == b[:2] and all(x == y if y is None else x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(a[2:], b[2:]))


def test_against_plain_counting(spark):
    rows = [(1, "good text is good text"), (2, "good text reads well"), (3, "bad bad spam"), (4, "spam bad text"), (5, ""), (6, None), (2, "the same id again"), (7, "good text reads well")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    close(score(docs, spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id long")).collect(), plain(rows, {1, 2}))


def test_target_like_documents_score_lower(spark):
    kinds = {"a": "the cat sat on the mat and saw the dog", "b": "buy cheap pills now click here win money"}
    rows = [(i, " ".join(reversed(kinds["ab"[i % 2]].split())) if i % 5 == 0 else kinds["ab"[i % 2]]) for i in range(40)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 20, 2)], "id long")).collect()}
    assert max(v for i, v in got.items() if i % 2 == 0) < min(v for i, v in got.items() if i % 2)


def test_a_document_that_comes_twice_is_foretold(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60))) for i in range(50)] + [(100, " ".join(f"w{j * 13 % 97}" for j in range(60)))] * 2
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(5)).collect()
    assert max(r.background_loss for r in got if r.doc_id == 100) < min(r.background_loss for r in got if r.doc_id < 50)


def test_odd_rows(spark):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    got = score(odd_documents(spark), ids).collect()
    assert len(got) == 11 and sum(r.score is None for r in got) == 4 and all((r.n_tokens == 0) == (r.score is None) for r in got)
    assert score(no_documents(spark), ids).collect() == []
    words = len({w for r in odd_documents(spark).collect() for w in (r.text or "").lower().split()})
    assert all(r.target_loss == pytest.approx(math.log(words)) for r in score(odd_documents(spark), ids.limit(0)).collect() if r.n_tokens)


def test_more_words_and_pairs_than_any_table_of_fixed_size_holds_apart(spark, monkeypatch):
    """90,000 different words, 120,000 different pairs, in small blocks and ranges."""
    monkeypatch.setattr(cross_entropy, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(cross_entropy, "RANGE_BYTES", 90_000)
    rows = [(i, " ".join(["the", *(f"w{i}x{j}" for j in range(300)), "the", "end", *(f"w{i}x{j}" for j in range(0, 300, 3))])) for i in range(300)]
    close(score(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(100)).collect(), plain(rows, set(range(100))))


def test_counts_and_patches_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        own = rng.integers(0, 3, n)
        sums = own + rng.choice([0, 0, 1, 254, 255, 10**12], n)
        assert (counts_of_bytes(counts_to_bytes(sums), n) == sums).all() and (patched(own, patch(own, sums)) == sums).all()
    assert counts_to_bytes(np.zeros(5, dtype=int)) == b"" == patch(own, own)
