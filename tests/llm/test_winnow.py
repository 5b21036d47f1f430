import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from cellseason.llm.queries import op5_fingerprints
from cellseason.llm.winnow import GRAM, WINDOW, compare_edited, fingerprint

from .helpers import clashing, no_documents, odd_documents


def brute_marks(text):
    h = []
    for w in (text or "").lower().split():
        h.append(xxhash.xxh64_intdigest(w.encode(), seed=42))
    grams = []
    for i in range(max(1, len(h) - GRAM + 1) if h else 0):
        seed = 42
        for x in h[i : i + GRAM]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=seed)
        grams.append(seed)
    out = []
    for i in range(max(1, len(grams) - WINDOW + 1) if grams else 0):
        part = [(g >> 33, -j) for j, g in enumerate(grams[i : i + WINDOW], i)]
        j = -min(part)[1]
        if (grams[j], j) not in out:
            out.append((grams[j], j))
    return out


def signed(marks):
    return [(g - (1 << 64) if g >> 63 else g, j) for g, j in marks]


def texts():
    rng = random.Random(4)
    words = ["a", "b", "the", "Ünï", "c\u00e9", "word"]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 19, 20, 21, 40, 200)] + ["same " * 60, None, " \n x"]


def test_marks_against_brute_force(spark):
    df = clashing(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))
    got = {r.doc_id: [(m.hash, m.pos) for m in r.marks] for r in fingerprint(df).collect()}
    assert got == {i: signed(brute_marks(t)) for i, t in enumerate(texts())}


def test_shared_passages_share_a_mark():
    rng = random.Random(5)
    word = lambda: str(rng.randint(0, 10**6))
    for _ in range(50):
        shared = [word() for _ in range(GRAM + WINDOW - 1)]
        a, b = ([*(word() for _ in range(rng.randint(0, 60))), *shared, *(word() for _ in range(rng.randint(0, 60)))] for _ in "ab")
        assert {g for g, _ in brute_marks(" ".join(a))} & {g for g, _ in brute_marks(" ".join(b))}


def brute_edited(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(2**63) if r[0] is None else r[0]))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for at, (i, t) in enumerate(rows):
        nxt = rows[(at + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        m, e, n = ({g for g, _ in brute_marks(x)} for x in (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(m, e), 9), round(like(m, n), 9)))
    return out


def test_edited_texts_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i * 7, " ".join(rng.choice(["é", "bb", "ccc", "d"]) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(None, "the first of all is this"), (5000, None), (5001, "")]
    rng.shuffle(rows)
    for parts in (1, 7):
        df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        got = [(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), round(r.near_edited, 9), round(r.near_next, 9)) for r in compare_edited(df).collect()]
        assert sorted(got, key=repr) == sorted(brute_edited(rows), key=repr)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op5_fingerprints(spark, sf).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(brute_edited(rows))
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows(spark):
    got = compare_edited(odd_documents(spark)).collect()
    assert len(got) == 11 and all(0 <= r.near_edited <= 1 for r in got)
    assert compare_edited(no_documents(spark)).collect() == [] and fingerprint(no_documents(spark)).collect() == []
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert [(r.edited, r.near_next) for r in compare_edited(one).collect()] == [("a b c a", 1.0)]
    assert compare_edited(one.select(F.lit(None).cast("long").alias("doc_id"), "text")).count() == 1
