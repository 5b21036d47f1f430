"""A training corpus out of ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellseason.llm import bpe, decontaminate, language, ngram_join
from cellseason.llm.common import shared_folder, table
from cellseason.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go, so do null texts and texts without a letter. Repeated rows are judged one by one;
    very long texts in pieces. No rows give no rows; in every stage other columns than those of documents go."""
    known = language.fit_dictionaries(docs.filter(~language.held_out()))
    return language.identify(docs, known, keep=tuple(COLUMNS)).filter("accepted").select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the least id stays (of equal ids the least hash of the text;
    a null id only if there is no other). Texts without words are in no group; of repeated rows one stays."""
    return ngram_join.keep_one_of_each(docs, ngram_join.near_groups(docs, hashes=True)).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go. Null and empty texts are clean; repeated rows are judged one by one."""
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS)).filter("not contaminated").select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of what is left, a row for each document; null and empty texts have no tokens."""
    return bpe.encode_decode(docs, WORD_BPE)


STAGES = [("language_id", keep_known_languages), ("ngram_join", keep_one_of_near_copies),
          ("benchmark_decontamination", drop_contaminated), ("bpe_encoding", tokenise)]

#: Compression, signatures and merges have no SQL form; a test compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
