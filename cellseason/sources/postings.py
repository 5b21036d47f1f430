"""A stored word index of documents: which word stands where in which document.

Three partitioned tables under one path: ``postings`` (term, key, positions) by bucket of the term; ``grams`` (gram, term), which finds
the terms that hold a string, by bucket of the gram; ``words`` (key, buckets), which knows what an update has to touch, by bucket of
the document. The number of buckets is the same in all calls on one index.

Words are runs of letters, digits and underscores of the text in lower case; a position is the number of the word in its document,
from 0. Null and empty texts have no word. Keys are unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.order import stored
from .readers import path_exists

BUCKETS = 64
#: Parts that a bucket is written in, so that the bucket of a frequent word is no single task.
PARTS = 4
GRAM = 3


def bucket_of(c: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def postings_of(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(term, key, positions, bucket)`` of every different word of every document. A document is one row, so its words are sorted and
    grouped inside it: nothing is exchanged."""
    at = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"[{tx.WORD}]+"), F.lit(0)), lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    rows = docs.select(key, F.sort_array(at).alias("__w")).filter(F.size("__w") > 0)
    word = lambda i: F.get("__w", i)["term"]
    first = F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))
    rows = rows.select(key, "__w", first.alias("__f"))
    groups = F.transform("__f", lambda i, k: F.struct(word(i).alias("term"), F.transform(
        F.slice("__w", i + 1, F.coalesce(F.get("__f", k + 1), F.size("__w")) - i), lambda e: e["at"]).alias("positions")))
    return rows.select(key, F.inline(groups)).select("term", key, "positions", bucket_of(F.col("term"), buckets).alias("bucket"))


def _grams(terms: DataFrame, buckets: int) -> DataFrame:
    """Every run of three characters of a term, and the shorter ones at its end."""
    starts = F.sequence(F.lit(1), F.length("term"))
    grams = terms.select("term", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("term", i, F.lit(GRAM))))).alias("gram"))
    return grams.select("gram", "term", bucket_of(F.col("gram"), buckets).alias("bucket"))


def _replace(spark: SparkSession, rows: DataFrame, path: str, touched: list[int], spread: str) -> None:
    """Writes the touched buckets anew. A row of NULLs in each makes a bucket that became empty be written too."""
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
    rows = rows.unionByName(marks, allowMissingColumns=True)
    (rows.repartition("bucket", F.pmod(F.xxhash64(spread), F.lit(PARTS))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def _merge(spark: SparkSession, fresh: DataFrame, path: str, touched: list[int], gone: DataFrame | None, key: list[str], spread: str) -> None:
    """``fresh`` instead of the rows of ``gone`` in the touched buckets. ``fresh`` does not read from ``path`` and has no row twice; what
    stays of the old rows is staged, so no bucket is read and overwritten in one job."""
    if not touched:
        return
    merged = fresh
    if path_exists(spark, path):
        old = spark.read.schema(fresh.schema).parquet(path).filter(F.col("bucket").isin(touched) & F.col(spread).isNotNull())
        merged = stored(old.join(gone, key, "left_anti") if gone is not None else old).unionByName(fresh)
    _replace(spark, merged, path, touched, spread)


def _buckets(df: DataFrame) -> list[int]:
    """Buckets of the rows: short numbers, as many as the index has."""
    return sorted(r[0] for r in df.select("bucket").distinct().collect())


def update_postings(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Enters ``docs``, new ones or new versions, and returns the buckets of ``postings`` that were rewritten; the others stay untouched.

    The first update makes the index. A null text takes a document out. Documents without a word leave nothing but their key. An
    update that broke off is made again with the same documents: ``words`` is extended before and cut down after ``postings`` changes."""
    fresh = stored(postings_of(docs, key, text, buckets))
    mine = fresh.groupBy(key).agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    keys = docs.select(key)
    now = stored(keys.join(mine, key, "left").select(key, F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets"), bucket_of(F.col(key), buckets).alias("bucket")))
    touched, terms = _buckets(fresh), fresh.select("term").distinct()
    homes = _buckets(now)
    if path_exists(spark, f"{path}/words"):
        known = spark.read.schema(now.schema).parquet(f"{path}/words").filter(F.col("bucket").isin(homes)).join(keys, key, "left_semi")
        old = [r[0] for r in known.select(F.explode("buckets")).distinct().collect()]
        touched = sorted(set(touched) | set(old))
        before = now.unionByName(known).groupBy(key, "bucket").agg(F.array_distinct(F.flatten(F.collect_list("buckets"))).alias("buckets")).select(now.columns)
        _merge(spark, stored(before), f"{path}/words", homes, keys, [key], key)
    grams = _grams(terms, buckets)
    if path_exists(spark, f"{path}/grams"):
        grams = grams.join(spark.read.schema("gram string, term string, bucket int").parquet(f"{path}/grams"), ["bucket", "gram", "term"], "left_anti").select(grams.columns)
    grams = stored(grams)
    _merge(spark, grams, f"{path}/grams", _buckets(grams), None, [], "term")
    _merge(spark, fresh, f"{path}/postings", touched, keys, [key], key)
    _merge(spark, now, f"{path}/words", homes, keys, [key], key)
    return touched


def is_word(query: str) -> bool:
    """No character that ends a word: all its hits lie inside words."""
    return bool(query) and all(c == "_" or c.isalnum() for c in query)


def matching_terms(spark: SparkSession, path: str, strings: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(query, term, hits, bucket)``: the terms that hold each string, and how often. Only the buckets of their first grams are read; strings
    shorter than a gram look through all terms."""
    low = [s.lower() for s in strings]
    grams = spark.read.schema("gram string, term string, bucket int").parquet(f"{path}/grams").filter("term is not null")
    if all(len(s) >= GRAM for s in low):
        first = sorted({s[:GRAM] for s in low})
        homes = [r[0] for r in spark.createDataFrame([(g,) for g in first], "gram string").select(bucket_of(F.col("gram"), buckets)).distinct().collect()]
        grams = grams.filter(F.col("bucket").isin(homes) & F.col("gram").isin(first))
    rows = F.array(*[F.struct(F.lit(s).alias("query"), tx.occurrences("term", s).alias("hits")) for s in strings])
    return (grams.select("term").distinct().select("term", F.inline(rows)).filter("hits > 0")
            .select("query", "term", "hits", bucket_of(F.col("term"), buckets).alias("bucket")))


def string_counts(spark: SparkSession, path: str, strings: list[str], key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """``(query, key, occurrences)``: case-insensitive, non-overlapping hits of strings of word characters, from the index alone."""
    if not all(is_word(s) for s in strings):
        raise ValueError("a string with other than word characters may reach over words")
    terms = stored(matching_terms(spark, path, strings, buckets))
    table = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(_buckets(terms)) & F.col("term").isNotNull())
    return (table.join(terms.drop("bucket"), "term").groupBy("query", key)
            .agg(F.sum(F.size("positions") * F.col("hits")).cast("int").alias("occurrences")))


def search_postings(spark: SparkSession, path: str, docs: DataFrame, query: str, top: int = 10, key: str = "doc_id", text: str = "text",
                    buckets: int = BUCKETS) -> DataFrame:
    """Documents that hold the string, most hits first (a top-k report; equal ones by key), with a preview of the first hit.

    A string inside words is counted from the index; texts are read for the ``top`` previews only. Any other string is counted in the texts of
    the documents that hold its longest word, and in all texts if it has none."""
    if is_word(query):
        counted = string_counts(spark, path, [query], key, buckets)
    else:
        pieces = "".join(c if is_word(c) else " " for c in query).split()
        held = docs
        if pieces:
            held = docs.join(string_counts(spark, path, [max(pieces, key=len)], key, buckets).select(key), key, "left_semi")
        counted = held.select(key, tx.occurrences(text, query).alias("occurrences")).filter("occurrences > 0")
    best = {r[key]: r["occurrences"] for r in counted.orderBy(F.desc("occurrences"), key).limit(top).select(key, "occurrences").collect()}
    shown = docs.filter(F.col(key).isin(list(best))) if best else docs.limit(0)
    return shown.select(key, tx.occurrences(text, query).alias("occurrences"), tx.preview(text, query).alias("preview"))
