import hashlib
import random
import re

from cellseason.llm import decontaminate
from cellseason.llm.decontaminate import find_contamination

from .helpers import clashing, no_documents, odd_documents


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, ids = tokens(text), set(), set()
        for item, question in items:
            q = tokens(question)
            for part in [q[a : a + 13] for a in range(max(1, len(q) - 12))] if q else []:
                for a in range(len(w) - len(part) + 1):
                    if w[a : a + len(part)] == part:
                        hit.update(range(a, a + len(part)))
                        ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice(["A", "b", "É", "ß9", "don", "t", "x1", "漢字"])
    line = lambda n: rng.choice([" ", "-", ", ", "\n"]).join(word() for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 5, 12, 13, 14, 30]))) for i in range(25)] + [(None, "only this null item"), (7, None), (3, "!?")]
    docs = []
    for i in range(120):
        parts = [line(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(items)[1] or "", line(rng.randint(0, 200))]
        docs.append((i, " | ".join(parts)))
    return docs, items


def run(spark, docs, items):
    got = find_contamination(clashing(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    return got, sorted((tuple(r)[:-1] for r in got.collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    assert run(spark, docs, items)[1] == brute(docs, items)
    monkeypatch.setattr(decontaminate, "PATTERN_CHARS", 150)  # several automata
    assert run(spark, docs, items)[1] == brute(docs, items)


def test_each_automaton_is_built_once_for_many_documents(spark, monkeypatch):
    import time

    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    docs = [(i, items[i % 300][1] if i % 7 == 0 else "plain words " * 20) for i in range(600)]
    monkeypatch.setattr(decontaminate, "PATTERN_CHARS", 300_000)
    assert len(decontaminate.blocks(decontaminate.item_windows(items), 300_000)) > 3
    start = time.time()
    got = {r.doc_id for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    assert got == {i for i in range(600) if i % 7 == 0} and time.time() - start < 60


def test_spans_are_of_the_original_text(spark):
    item = " ".join(f"w{i}" for i in range(13))
    doc = "Ünï -- códe: " + item.upper().replace(" ", " - ") + "! tail é"
    spans = run(spark, [(1, doc)], [(1, item)])[0].first().spans
    assert [doc[s.start : s.stop] for s in spans] == [item.upper().replace(" ", " - ")]


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "12 34")], "item_id long, text string")
    got = find_contamination(odd_documents(spark), items, keep=("text",)).collect()
    assert len(got) == 11 and {r.doc_id for r in got if r.contaminated} == {5, 7}
    assert find_contamination(no_documents(spark), items).collect() == []
    assert not any(r.contaminated for r in find_contamination(odd_documents(spark), items.limit(0)).collect())
