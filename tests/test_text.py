import re

from pyspark.sql import functions as F

from cellseason.functions import text as tx
from cellseason.operators import text as kit

from .conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_sections(spark):
    t = "# Un\nabc\n## Deux  trois \n\ndef\n#pas un titre\n####### non plus\n###### Six"
    got = rows(kit.sections(docs(spark, t, "sans titre", "")).select("section_no", "level", "title", "start_line", "body", "prev_title", "next_title"), "section_no")
    assert got == [(1, 1, "Un", 1, "# Un\nabc", None, "Deux  trois"),
                   (2, 2, "Deux  trois", 3, "## Deux  trois \n\ndef\n#pas un titre\n####### non plus", "Un", "Six"),
                   (3, 6, "Six", 8, "###### Six", "Deux  trois", None)]


def test_anchor_matches_the_text_rule(spark):
    titles = ["Été à la mer !", "A  --  b_c", "Télédétection (NDVI) & co", "x y", "1.2 Intro"]
    want = [re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", t.lower())) for t in titles]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(tx.anchor("t")).collect()] == want


def brute_chunks(t, size=1000, overlap=200):
    out, start = [], 0
    while start < len(t):
        end, piece = start + size, t[start:start + size]
        if end < len(t):
            nl = piece.rfind("\n")
            if nl > size // 2:
                end = start + nl
                piece = t[start:end]
        out.append((piece, start, end, len(piece)))
        start = end - overlap
    return out


def test_chunks_against_the_loop(spark):
    texts = ["", "court", "é" * 1000, "x" * 2500, ("mot " * 60 + "\n") * 40, "\n" * 1500, "a" * 501 + "\n" + "b" * 900, "a" * 500 + "\n" + "b" * 900, "🦗é\n" * 900]
    got = {}
    for r in kit.chunk_documents(docs(spark, *texts)).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["start"], r["end"], r["length"]))
        assert r["end_clamped"] == min(r["end"], len(texts[r["doc_id"]]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_chunks(t)
    small = kit.chunk_documents(docs(spark, "abc\ndefghijkl"), size=6, overlap=1).orderBy("chunk_id").collect()
    assert [(r["text"], r["start"]) for r in small] == [(p, s) for p, s, _, _ in brute_chunks("abc\ndefghijkl", 6, 1)]


def test_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(tx, "_RUN", 3)
    t = ("é🦗 mot" * 7 + "\n") * 900
    got = kit.chunk_documents(docs(spark, t, None), size=100, overlap=30).orderBy("chunk_id").collect()
    assert [(r["text"], r["start"], r["end"], r["length"]) for r in got] == brute_chunks(t, 100, 30)


def test_overlap_must_let_chunks_advance():
    try:
        tx.chunks("t", 100, 60)
        raise AssertionError("accepted")
    except ValueError:
        pass


def test_search_and_preview(spark):
    body = "a" * 150 + " Criquet " + "b" * 150 + "criquet"
    d = docs(spark, body, "rien", "CRIQUET").select("doc_id", F.col("text").alias("content"), F.lit(1).alias("section_no"))
    got = rows(kit.search_sections(d, "criquet"))
    at = body.lower().find("criquet")
    preview = "..." + body[at - 100:at + 107] + "..."
    assert got == [(0, 1, "Sans titre", 2, preview.strip()), (2, 1, "Sans titre", 1, "CRIQUET")]


def test_pages_round_trip_metadata_and_navigation(spark):
    s = kit.sections(docs(spark, "# Un\nabc\n## Deux\ndef"))
    pages = kit.section_pages(s)
    assert rows(kit.with_metadata(pages).select("section_no", "title", "source", "level"), "section_no") == [(1, "Un", "0.md", 1), (2, "Deux", "0.md", 2)]
    first = pages.filter("section_no = 1").first()["content"]
    assert "→ [Section suivante: Deux](section_002_deux.md)" in first and "←" not in first and "> Position: ligne 1\n" in first
    rec = rows(kit.jsonl_records(pages).select("id", "title", "level", "content"), "id")
    assert rec[0][0] == "0_section_001" and rec[0][3].endswith("---\n\n# Un\nabc") and "Navigation" not in rec[0][3]
    idx = rows(kit.section_index(s).select("index_line", "prev_file", "next_file"), "index_line")
    assert ("- [Un](0_sections/section_001_un.md)", None, "section_002_deux.md") in idx and idx[0][0].startswith("  - [Deux]")


def test_keyword_tables(spark):
    d = docs(spark, "Lutte et lutte", "la LUTTE\nNDVI", "vide")
    got = {(r["keyword"], r["doc_id"]): (r["total"], r["n_documents"]) for r in kit.keyword_index(d).collect()}
    assert got == {("lutte", 0): (2, 1), ("lutte", 1): (1, 1), ("lutte", None): (3, 2), ("NDVI", 1): (1, 1), ("NDVI", None): (1, 1)}
    st = rows(kit.document_stats(docs(spark, "# T\nun  deux\n", "")), "doc_id")
    assert st == [(0, 13, 4, 2, 1), (1, 0, 0, 0, 0)]


def test_context_glossary_links_clean(spark):
    t = "l1\nl2\nl3 Mot\nl4\nl5\nl6 mot\n"
    got = rows(kit.keyword_context(docs(spark, t), "MOT", 1), "line")
    assert got == [(0, 3, "l2\nl3 Mot\nl4\n"), (0, 6, "l5\nl6 mot\n")]
    g = kit.glossary(docs(spark, "x\nLe Mot clé : sens\nmot\nautre mot: a\nmot:1\nmot:2"), ["mot"]).first()
    assert g["n"] == 5 and g["definitions"] == ["Le Mot clé : sens", "autre mot: a", "mot:1"]
    assert rows(kit.document_links(docs(spark, "[a](b) et [c d](e/f)")).select("link_no", "label", "target")) == [(1, "a", "b"), (2, "c d", "e/f")]
    assert docs(spark, "  a   b\n\n\n\n\nc \n").select(tx.clean_text("text")).first()[0] == "a b\n\nc"
    assert [r[0] for r in kit.headings_of_level(kit.sections(docs(spark, "# a\n## b\n## c")), 2).select("title").collect()] == ["b", "c"]
