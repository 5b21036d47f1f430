from pyspark.sql import functions as F

from cellseason.llm.language import UNDETERMINED, fit_dictionaries, held_out, identify
from cellseason.llm.queries import op4_language_id

from .helpers import no_documents, odd_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op4_language_id(spark, SF).join(docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").collect()
    assert len(got) == docs.count()
    unseen = [r for r in got if r.held_out]
    assert 150 < len(unseen) < 350
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.98 * len(unseen)
    assert all(r.lang_pred == r.lang and r.accepted for r in unseen if r.size > 2000) or sum(r.lang_pred != r.lang for r in unseen if r.size > 2000) <= 1
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(not r.accepted for r in got) <= 0.02 * len(got)


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(200).select("id", held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_odd_rows(spark):
    known = {"en": b"the quick brown fox jumps over the lazy dog one two three four five six seven a text without an id but with words ", "xx": b"zzz qqq yyy " * 9}
    got = {(r.doc_id, r.text): r for r in identify(odd_documents(spark), known, keep=("text",)).collect()}
    assert all((r.lang_pred == UNDETERMINED) == (not t or not any(c.isalpha() for c in t)) for (_, t), r in got.items())
    assert not any(r.accepted for r in got.values() if r.lang_pred == UNDETERMINED)
    assert got[1, "One two three four five six seven."].lang_pred == "en"
    assert identify(no_documents(spark), known).collect() == []
    assert {r.lang_pred for r in identify(odd_documents(spark), {}).collect()} == {UNDETERMINED}


def test_fit_reads_labelled_text_only(spark):
    rows = [("hallo welt", "de"), ("hello world", "en"), ("hello world", "en"), ("no label", None), (None, "fr"), ("123", "es")]
    got = fit_dictionaries(spark.createDataFrame(rows, "text string, lang string"))
    assert got == {"de": b"hallo welt ", "en": b"hello world "}
    assert fit_dictionaries(spark.createDataFrame([], "text string, lang string")) == {}


def test_margin_does_not_shrink_with_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = fit_dictionaries(docs.filter(~held_out()))
    texts = docs.filter(held_out()).groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select(
        F.monotonically_increasing_id().alias("doc_id"), "lang", F.col("text").substr(1, 3_000_000).alias("text"))
    rows = texts.unionByName(texts.select((F.col("doc_id") + 10**12).alias("doc_id"), "lang", F.substring("text", 1, 10_000).alias("text"))).localCheckpoint()
    got = {(r.lang, r.doc_id >= 10**12): r for r in identify(rows, known, keep=("lang",)).collect()}
    assert rows.agg(F.max(F.length("text"))).first()[0] > 2_000_000
    for (lang, short), r in got.items():
        assert r.accepted and r.lang_pred == lang and (short or r.score > got[lang, True].score / 2), (r, got[lang, True])
