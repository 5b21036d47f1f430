"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_entropy, decontaminate, html_wrapper, language, lexical, merkle, mixing, ngram_join, oracles, sharding, token_counts, url_rules, winnow
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their texts go into shards; sizes and checksums are those of what arrived."""
    dealt = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 8, ("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnow.written(winnow.hashes(F.col("marks"))).alias("fingerprint"),
                        winnow.written(winnow.hashes(F.col("edited_marks"))).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: some words in the middle, a cut near the start, its own first words once more at the end."""
    n = F.char_length("text")
    edit = lambda start, stop, insert: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), insert.alias("insert"))
    middle, early, end = F.floor(n / 2), F.floor(n / 10), n + 10
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(
        edit(middle, middle + 10, F.lit(" put in by 1 edit, ")), edit(early, early + 5, F.lit("")), edit(end, end, F.substring("text", 1, 40))).alias("edits"))
    return token_counts.count_edited(docs, BYTE_BPE, public_tokenizers.PATTERN)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy.score(table(spark, sf_dir, "documents"), good)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language.fit_dictionaries(docs.filter(~language.held_out()))
    return language.identify(docs, known).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering deletes the line feeds of the text where 2 divides the crc32 of the id; the siblings are those of the manifest."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    shown = merkle.leaf(*[text if f == "text" else F.col(f) for f in fields])
    proven = merkle.prove(table(spark, sf_dir, "documents"), fields, shown=shown)
    proven = proven.withColumn("folded_root", merkle.fold(F.col("shown"), F.col("path")))
    return proven.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op5_fingerprints": op5_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
    "op4_language_id": op4_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op11_lexical_search": op11_lexical_search,
    "op12_mixing": op12_mixing,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {"op1_url_filter": oracles.URL_FILTER, "op8_decontamination": oracles.DECONTAMINATION, "op11_lexical_search": oracles.LEXICAL_SEARCH,
                           "op12_mixing": oracles.MIXING, "op13_merkle_manifest": oracles.MERKLE_MANIFEST}
