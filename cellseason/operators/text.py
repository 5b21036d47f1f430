"""Document kit: sections, search, chunks, keyword index. One document is one row; everything that looks
at a single document is folded inside that row, so splitting and searching do not shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KEYWORDS
from ..functions import text as tx


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = tx.HEADING) -> DataFrame:
    """Heading sections ``(key, section_no, level, title, start_line, body, prev_title, next_title)``.

    ``start_line`` is 1-based; the body runs from the heading line to the line before the next heading.
    Documents without a heading give no row. ``heading`` captures the marks (level) and the title."""
    rx = "(?d)" + heading
    ls = docs.select(key, tx.lines(text).alias("ls"))
    heads = F.filter(F.transform("ls", lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda h: F.regexp_like(h["l"], F.lit(rx)))
    parsed = F.transform(heads, lambda h: F.struct(
        h["i"].alias("i"), F.length(F.regexp_extract(h["l"], rx, 1)).alias("level"),
        tx.strip(F.regexp_extract(h["l"], rx, 2)).alias("title")))
    ls = ls.select(key, "ls", parsed.alias("hs"))
    row = F.transform("hs", lambda h, k: F.struct(
        (k + 1).alias("section_no"), h["level"].alias("level"), h["title"].alias("title"), (h["i"] + 1).alias("start_line"),
        F.array_join(F.slice(F.col("ls"), h["i"] + 1, F.coalesce(F.get("hs", k + 1)["i"], F.size("ls")) - h["i"]), "\n").alias("body"),
        F.get("hs", k - 1)["title"].alias("prev_title"), F.get("hs", k + 1)["title"].alias("next_title")))
    return ls.select(key, F.inline(row))


def section_file(number: Column, title: Column) -> Column:
    return F.concat(F.lit("section_"), F.lpad(number.cast("string"), 3, "0"), F.lit("_"), F.substring(tx.anchor(title), 1, 50), F.lit(".md"))


def section_index(secs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Index line of every section, indented by level, with the files of its neighbours."""
    no = F.col("section_no")
    name = section_file(no, F.col("title"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.col("title"), F.lit("]("),
                    F.col(key).cast("string"), F.lit("_sections/"), name, F.lit(")"))
    return secs.select(key, "section_no", "level", "title", "start_line", name.alias("file"), line.alias("index_line"),
                       F.when(F.col("prev_title").isNotNull(), section_file(no - 1, F.col("prev_title"))).alias("prev_file"),
                       F.when(F.col("next_title").isNotNull(), section_file(no + 1, F.col("next_title"))).alias("next_file"))


def section_pages(secs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stand-alone section texts: header, body and navigation block."""
    # The French phrases of header and navigation.
    no, doc = F.col("section_no"), F.col(key).cast("string")
    head = F.concat(F.lit("# Section "), no.cast("string"), F.lit(": "), F.col("title"), F.lit("\n\n> Extrait de: "), doc,
                    F.lit(".md\n> Niveau: "), F.col("level").cast("string"), F.lit("\n> Position: ligne "),
                    F.col("start_line").cast("string"), F.lit("\n\n---\n\n"))
    back = F.when(F.col("prev_title").isNotNull(), F.concat(
        F.lit("← [Section précédente: "), F.col("prev_title"), F.lit("]("), section_file(no - 1, F.col("prev_title")), F.lit(")\n\n"))).otherwise("")
    up = F.concat(F.lit("↑ [Retour à l'index](../"), doc, F.lit("_INDEX_DETAILLE.md)\n\n"))
    fwd = F.when(F.col("next_title").isNotNull(), F.concat(
        F.lit("→ [Section suivante: "), F.col("next_title"), F.lit("]("), section_file(no + 1, F.col("next_title")), F.lit(")\n"))).otherwise("")
    nav = F.concat(F.lit("\n\n---\n\n## Navigation\n\n"), back, up, fwd)
    return secs.select(key, "section_no", F.concat(head, F.col("body"), nav).alias("content"))


def with_metadata(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"title": tx.section_title("content"), "source": tx.section_source("content"),
                              "level": tx.section_level("content")})


def search_sections(pages: DataFrame, query: str, top: int = 10, key: str = "doc_id") -> DataFrame:
    """Sections that hold the query, most hits first (a top-k report), with a preview of the first hit."""
    hits = tx.occurrences("content", query)
    return (pages.withColumn("occurrences", hits).filter("occurrences > 0")
            .orderBy(F.desc("occurrences"), key, "section_no").limit(top)
            .select(key, "section_no", F.coalesce(tx.section_title("content"), F.lit("Sans titre")).alias("title"),
                    "occurrences", tx.preview("content", query).alias("preview")))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks ``(key, chunk_id, text, start, end, end_clamped, length)`` over the whole text."""
    spans = docs.select(key, F.length(text).alias("__n"), F.posexplode(tx.chunks(text, size, overlap)).alias("p", "s"))
    return spans.select(key, (F.col("p") + 1).alias("chunk_id"), F.col("s.text").alias("text"), F.col("s.start").alias("start"),
                        F.col("s.end").alias("end"), F.least(F.col("s.end"), F.col("__n")).alias("end_clamped"),
                        F.length("s.text").alias("length"))


def keyword_index(docs: DataFrame, key: str = "doc_id", text: str = "text", keywords=KEYWORDS) -> DataFrame:
    """Hits per (keyword, document) plus the total per keyword (``key`` NULL), in one grouped pass."""
    counts = F.array(*[F.struct(F.lit(k).alias("keyword"), tx.occurrences(text, k).alias("n")) for k in keywords])
    return keyword_totals(docs.select(key, F.inline(counts)).filter("n > 0"), key)


def keyword_totals(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(keyword, key, n)`` to hits per (keyword, document) and per keyword (``key`` NULL)."""
    return (counts.groupingSets([[F.col("keyword"), F.col(key)], [F.col("keyword")]], F.col("keyword"), F.col(key))
            .agg(F.sum("n").alias("total"), F.count("*").alias("n_documents")))


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = tx.HEADING) -> DataFrame:
    """Characters, words, lines and heading count per document."""
    rx = F.lit("(?d)" + heading)
    return docs.select(key, F.length(text).alias("characters"), tx.word_count(text).alias("words"),
                       (F.size(tx.lines(text)) - 1).alias("line_feeds"),
                       F.size(F.filter(tx.lines(text), lambda l: F.regexp_like(l, rx))).alias("sections"))


def headings_of_level(secs: DataFrame, level: int, key: str = "doc_id") -> DataFrame:
    return secs.filter(F.col("level") == level).select(key, "section_no", "title")


def keyword_context(docs: DataFrame, keyword: str, around: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines around every line that holds the keyword (case-insensitive); line numbers are 1-based."""
    ls = docs.select(key, F.col(text).endswith("\n").alias("nl"), tx.file_lines(text).alias("ls"))
    at = F.filter(F.transform("ls", lambda l, i: F.when(F.contains(F.lower(l), F.lit(keyword.lower())), i)), lambda i: i.isNotNull())
    hit = ls.select(key, "nl", "ls", F.explode(at).alias("i"))
    lo = F.greatest(F.lit(0), F.col("i") - around)
    hi = F.least(F.size("ls"), F.col("i") + around + 1)
    tail = F.when((hi < F.size("ls")) | F.col("nl"), "\n").otherwise("")
    return hit.select(key, (F.col("i") + 1).alias("line"), F.concat(F.array_join(F.slice("ls", lo + 1, hi - lo), "\n"), tail).alias("context"))


def glossary(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits and first definition lines per (document, term)."""
    rows = F.array(*[F.struct(F.lit(t).alias("term"), tx.occurrences(text, t).alias("n"),
                              tx.definitions(text, t).alias("definitions")) for t in terms])
    return docs.select(key, F.inline(rows))


def document_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return (docs.select(key, F.posexplode(tx.links(text)).alias("p", "l"))
            .select(key, (F.col("p") + 1).alias("link_no"), F.col("l.label").alias("label"), F.col("l.target").alias("target")))


def jsonl_records(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned section records ready for a JSON-lines sink."""
    doc = F.col(key).cast("string")
    return pages.select(
        F.concat(doc, F.lit("_section_"), F.lpad(F.col("section_no").cast("string"), 3, "0")).alias("id"),
        F.coalesce(tx.section_title("content"), F.lit("")).alias("title"), F.coalesce(tx.section_level("content"), F.lit(1)).alias("level"),
        tx.without_navigation("content").alias("content"), doc.alias("source"))
