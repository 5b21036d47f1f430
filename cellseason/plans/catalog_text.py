"""Queries for the document kit and the map exports (T, A10-A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import outputs
from ..operators import text as kit
from ..session import scratch_dir
from ..sources import postings, sinks
from .bindings import Views, spread
from .catalog_space import BOX_TEXT, MAP_SQL, maps
from .registry import query

WORLD = "(SELECT m.cell_id, m.AIRE_CODE, m.severite, c.cell_col, c.cell_row FROM (SELECT cell_id, AIRE_CODE, max(severite) AS severite FROM %s a GROUP BY 1, 2) m JOIN cells_v c USING (cell_id))" % MAP_SQL


def worst_map(v: Views):
    """The worst level of each cell over all decades."""
    return outputs.cell_map(maps(v))


@query("A10_geojson", f"""
SELECT cell_id, concat('{{"type":"Feature","properties":{{"cell_id":"', cell_id, '","AIRE_CODE":', AIRE_CODE, ',"severite":', severite, '}},"geometry":', {BOX_TEXT}, '}}') AS feature FROM (
  SELECT cell_id, AIRE_CODE, severite, cell_col * 1000 AS x0, cell_row * 1000 AS y0, (cell_col + 1) * 1000 AS x1, (cell_row + 1) * 1000 AS y1 FROM {WORLD} w) b""")
def _(v: Views):
    path = scratch_dir(v.spark, "geojson")
    f = outputs.geojson_features(worst_map(v), v.cells, ["AIRE_CODE", "severite"])
    sinks.write_lines(f, "feature", path)
    back = v.spark.read.text(path)
    return back.select(F.get_json_object("value", "$.properties.cell_id").alias("cell_id"), F.col("value").alias("feature"))


@query("A11_raster", f"""
WITH w AS (SELECT * FROM {WORLD} w0), b AS (SELECT min(cell_col) AS c0, max(cell_col) AS c1, min(cell_row) AS r0, max(cell_row) AS r1 FROM w),
p AS (SELECT c0, r1, c, unnest(range(r0, r1 + 1)) AS r FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM b) x)
SELECT CAST(r1 - r AS INTEGER) AS px_row, CAST(c - c0 AS INTEGER) AS px_col, CAST(coalesce(w.severite, 255) AS INTEGER) AS value FROM p LEFT JOIN w ON w.cell_col = p.c AND w.cell_row = p.r""")
def _(v: Views):
    return outputs.raster_pixels(worst_map(v), v.cells)


# --- sections --------------------------------------------------------------------------------------------------------------

B = tx.BLANK
RX = f"^(#{{1,6}})[{B}]+(.+)$"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{B}]+|[{B}]+$', '', 'g')"


def anchor_sql(x: str) -> str:
    kept = "regexp_replace(lower(" + x + "), '[^\\p{L}\\p{N}_" + B + "-]', '', 'g')"
    return f"regexp_replace({kept}, '[-{B}]+', '-', 'g')"


SECTIONS = f"""(SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS section_no, CAST(length(regexp_extract(l, '{RX}', 1)) AS INTEGER) AS level,
  {strip_sql(f"regexp_extract(l, '{RX}', 2)")} AS title, CAST(i AS INTEGER) AS start_line, coalesce(lead(i) OVER w, n + 1) AS stop, ls FROM (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, len(ls) AS n, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM md_v) a) b
  WHERE regexp_matches(l, '{RX}') WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
BODY = "array_to_string(list_slice(ls, start_line, stop - 1), chr(10))"


@query("T1_sections", f"SELECT doc_id, section_no, level, title, start_line, {BODY} AS body FROM {SECTIONS} s")
def _(v: Views):
    return kit.sections(v.markdown).drop("prev_title", "next_title")


@query("A12_sections_jsonl", f"""
SELECT concat(doc_id, '_section_', lpad(CAST(section_no AS VARCHAR), 3, '0')) AS id, title, level, CAST(doc_id AS VARCHAR) AS source,
  {strip_sql(f"concat('# Section ', section_no, ': ', title, chr(10), chr(10), '> Extrait de: ', doc_id, '.md', chr(10), '> Niveau: ', level, chr(10), '> Position: ligne ', start_line, chr(10), chr(10), '---', chr(10), chr(10), {BODY})")} AS content FROM {SECTIONS} s""")
def _(v: Views):
    path = scratch_dir(v.spark, "jsonl")
    sinks.write_jsonl(kit.jsonl_records(kit.section_pages(kit.sections(v.markdown))), path)
    return v.spark.read.schema("id STRING, title STRING, level INT, content STRING, source STRING").json(path)


@query("T1_custom_heading", r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS section_no, CAST(i AS INTEGER) AS start_line, l AS title FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) a WHERE regexp_matches(l, '^[A-Z][a-z]+ .+\.$')""")
def _(v: Views):
    """Sections by another heading rule: lines that start with a plain capitalised word and end a sentence."""
    s = kit.sections(v.documents, heading=r"^()([A-Z][a-z]+ .+\.)$")
    return s.select("doc_id", "section_no", "start_line", "title")


@query("T2_anchors", f"SELECT doc_id, section_no, {anchor_sql('title')} AS anchor FROM {SECTIONS} s")
def _(v: Views):
    return kit.sections(v.markdown).select("doc_id", "section_no", tx.anchor("title").alias("anchor"))


def file_sql(no: str, title: str) -> str:
    return f"concat('section_', lpad(CAST({no} AS VARCHAR), 3, '0'), '_', substr({anchor_sql(title)}, 1, 50), '.md')"


@query("T3_section_index", f"""
SELECT doc_id, section_no, level, title, start_line, {file_sql('section_no', 'title')} AS file, concat(repeat('  ', level - 1), '- [', title, '](', doc_id, '_sections/', {file_sql('section_no', 'title')}, ')') AS index_line,
  CASE WHEN pt IS NOT NULL THEN {file_sql('section_no - 1', 'pt')} END AS prev_file, CASE WHEN nt IS NOT NULL THEN {file_sql('section_no + 1', 'nt')} END AS next_file
FROM (SELECT *, lag(title) OVER w AS pt, lead(title) OVER w AS nt FROM {SECTIONS} s WINDOW w AS (PARTITION BY doc_id ORDER BY section_no)) q""")
def _(v: Views):
    return kit.section_index(kit.sections(v.markdown))


@query("T4_section_metadata", f"SELECT doc_id, section_no, title, concat(doc_id, '.md') AS source, level FROM {SECTIONS} s")
def _(v: Views):
    return kit.with_metadata(kit.section_pages(kit.sections(v.markdown))).drop("content")


SEARCH_SQL = """
SELECT doc_id, n AS occurrences, trim(concat(CASE WHEN a > 0 THEN '...' ELSE '' END, substr(text, a + 1, z - a), CASE WHEN z < length(text) THEN '...' ELSE '' END), concat(' ', chr(10))) AS preview FROM (
  SELECT doc_id, text, n, greatest(0, pos - 100) AS a, least(length(text), pos + 5 + 100) AS z FROM (
    SELECT doc_id, text, CAST((length(text) - length(replace(lower(text), 'eleau', ''))) // 5 AS INTEGER) AS n, strpos(lower(text), 'eleau') - 1 AS pos FROM documents) x WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 10) y"""


@query("T5_search", SEARCH_SQL)
def _(v: Views):
    docs = v.documents.select("doc_id", F.col("text").alias("content"), F.lit(1).alias("section_no"))
    return kit.search_sections(docs, "eLeau").select("doc_id", "occurrences", "preview")


#: Buckets of the index in the queries, few because each is a folder with files of its own.
BUCKETS = 8


def stored_postings(v: Views) -> str:
    """A word index of all documents that has been updated: the even documents first with other texts, then all with their own."""
    path = scratch_dir(v.spark, "index")
    even = v.documents.filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("eleau tion NDVI "), F.reverse("text")).alias("text"))
    postings.update_postings(v.spark, even, path, buckets=BUCKETS)
    postings.update_postings(v.spark, v.documents, path, buckets=BUCKETS)
    return path


@query("T5_search_postings", SEARCH_SQL)
def _(v: Views):
    """The same search from the stored index: no text is scanned for hits."""
    return postings.search_postings(v.spark, stored_postings(v), v.documents, "eLeau", buckets=BUCKETS)


CHUNKS_SQL = """
WITH RECURSIVE c AS (
  SELECT doc_id, text, 1 AS chunk_id, 0 AS a, z FROM (SELECT doc_id, text, {end0} AS z FROM documents WHERE length(text) > 0) s
  UNION ALL SELECT doc_id, text, chunk_id + 1, z - 200, {end1} FROM c WHERE z - 200 < length(text))
SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, substr(text, a + 1, z - a) AS text, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS "end",
  CAST(least(z, length(text)) AS INTEGER) AS end_clamped, CAST(length(substr(text, a + 1, z - a)) AS INTEGER) AS length FROM c"""


def _end(a: str) -> str:
    w = f"substr(text, {a} + 1, 1000)"
    last = f"(length({w}) - strpos(reverse({w}), chr(10)))"
    return f"CASE WHEN {a} + 1000 < length(text) AND strpos({w}, chr(10)) > 0 AND {last} > 500 THEN {a} + {last} ELSE {a} + 1000 END"


@query("T6_chunks", CHUNKS_SQL.format(end0=_end("0"), end1=_end("z - 200")))
def _(v: Views):
    return kit.chunk_documents(v.documents)


WORDS = ("eau", "tion", "ment", "the", "und", "NDVI")


KEYWORDS_SQL = f"""
SELECT keyword, doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_documents FROM (SELECT k AS keyword, doc_id, (length(text) - length(replace(lower(text), lower(k), ''))) // length(k) AS n
  FROM documents CROSS JOIN (SELECT unnest({list(WORDS)!r}) AS k) w) q WHERE n > 0 GROUP BY GROUPING SETS ((keyword, doc_id), (keyword))"""


@query("T7_keyword_index", KEYWORDS_SQL)
def _(v: Views):
    return kit.keyword_index(v.documents, keywords=WORDS)


@query("T7_keyword_postings", KEYWORDS_SQL)
def _(v: Views):
    """The same counts from the stored index: only the buckets of matching terms are read."""
    counts = postings.string_counts(v.spark, stored_postings(v), list(WORDS), buckets=BUCKETS)
    return kit.keyword_totals(counts.select(F.col("query").alias("keyword"), "doc_id", F.col("occurrences").alias("n")))


@query("T7_document_stats", f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, CAST(len(list_filter(regexp_split_to_array(text, '[{B}]+'), lambda w: w <> '')) AS INTEGER) AS words,
  CAST(len(string_split(text, chr(10))) - 1 AS INTEGER) AS line_feeds, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{RX}'))) AS INTEGER) AS sections FROM md_v""")
def _(v: Views):
    return kit.document_stats(v.markdown)


@query("T8_headings_of_level", f"SELECT doc_id, section_no, title FROM {SECTIONS} s WHERE level = 2")
def _(v: Views):
    return kit.headings_of_level(kit.sections(v.markdown), 2)


@query("T9_keyword_context", """
SELECT doc_id, CAST(i AS INTEGER) AS line, concat(array_to_string(list_slice(ls, greatest(1, i - 3), least(n, i + 3)), chr(10)), CASE WHEN i + 3 < n OR nl THEN chr(10) ELSE '' END) AS context FROM (
  SELECT doc_id, ls, len(ls) AS n, nl, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, suffix(text, chr(10)) AS nl, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM documents WHERE text <> '') a) b WHERE contains(lower(l), 'queau')""")
def _(v: Views):
    return kit.keyword_context(v.documents, "Queau")


@query("T10_glossary", """
SELECT doc_id, k AS term, CAST((length(text) - length(replace(lower(text), lower(k), ''))) // length(k) AS INTEGER) AS n, array_to_string(list_slice(regexp_extract_all(text, concat('(?mi)^.*', k, '.*:.*$')), 1, 3), '|') AS definitions
FROM md_v CROSS JOIN (SELECT unnest(['thedment', 'ation']) AS k) w""")
def _(v: Views):
    g = kit.glossary(v.markdown, ["thedment", "ation"])
    return g.withColumn("definitions", F.array_join("definitions", "|"))


@query("T11_clean_text", f"SELECT page_id, {strip_sql('''regexp_replace(regexp_replace(replace(html, '><', concat('>   ', chr(10), chr(10), chr(10), chr(10), '<')), ' +', ' ', 'g'), concat(chr(10), '{3,}'), concat(chr(10), chr(10)), 'g')''')} AS text FROM pages")
def _(v: Views):
    loose = F.replace(F.col("html"), F.lit("><"), F.lit(">   \n\n\n\n<"))
    return spread(v.table("pages"), "page_id").select("page_id", tx.clean_text(loose).alias("text"))


@query("T12_links", r"""
SELECT doc_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS link_no, unnest(a) AS label, unnest(b) AS target FROM (
  SELECT doc_id, regexp_extract_all(text, '\[(.+?)\]\((.+?)\)', 1) AS a, regexp_extract_all(text, '\[(.+?)\]\((.+?)\)', 2) AS b FROM md_v) q""")
def _(v: Views):
    return kit.document_links(v.markdown)
