"""Document fingerprints by winnowing: the smallest k-gram hash of every window, rightmost of equals, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, partitions, rank_in

#: Words of a k-gram; k-grams of a window, a power of two. Any GRAM + WINDOW - 1 words that two texts share give a common mark.
GRAM, WINDOW = 5, 16
_LOW = 0xFFFFFFFF


def _shifted(values: Column, by: int) -> Column:
    """Each value and the one ``by`` places on, the smaller; past the end the value itself."""
    return F.transform(values, lambda x, i: F.least(x, F.get(values, i + by)))


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash, pos>> in order of position (of the k-gram's first word); fewer words than ``gram`` are one k-gram,
    fewer k-grams than ``window`` one window; no words, no marks. Words are split at white space, in lower case.

    The order of hashes is that of their upper 31 bits; with the position below them, the smallest is the rightmost of equals.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        rolled = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, gram)]))
        return F.slice(rolled, 1, F.greatest(F.size(h) - (gram - 1), F.lit(1)))

    def chosen(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(_LOW) - i))

        def minima(values: Column, width: int) -> Column:
            if width == window:
                return F.array_distinct(F.slice(values, 1, F.greatest(F.size(values) - (window - 1), F.lit(1))))
            return let(_shifted(values, width), lambda v: minima(v, width * 2))

        def mark(x: Column) -> Column:
            pos = (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int")
            return F.struct(F.get(g, pos).alias("hash"), pos.alias("pos"))

        return F.transform(let(packed, lambda p: minima(p, 1)), mark)

    return let(hashes, lambda h: let(grams(h), chosen))


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda m: m["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def written(a: Column) -> Column:
    """Hashes as one string of hexadecimal digits."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col`` and marks (array of hash and pos). Null and empty texts have no marks, equal texts have equal
    marks; repeated rows are marked one by one; whole texts count. Nothing is shuffled."""
    return docs.select(id_col, marks(F.coalesce(text_col, F.lit(""))).alias("marks"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, text, marks, next_text and next_marks: of the next document by ascending id, after the last the first.

    Ids are whole numbers (or can be cast to them); other ids are an error of the cast. No documents give no rows; other columns go.

    Null texts count as empty, a null id comes first, rows of equal ids follow the hash of their text. Ids are dealt out to blocks
    by cuts that are ids themselves; the first row of a block is also laid at the end of the block before it, so every block finds its
    successors by itself and texts move once.
    """
    n = partitions(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = rows.agg(F.min("key").alias("low"), F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("cuts")).first()
    cuts = sorted({found.low, *(found.cuts or [])}) if found.low is not None else [0]
    kept = F.array(*[F.lit(c) for c in cuts])
    block = rank_in(kept, len(cuts), F.col("key")) - 1
    before = F.pmod(F.col("block") - 1, F.lit(len(cuts)))
    laid = (rows.withColumn("block", block).withColumn("copy", F.when(F.get(kept, F.col("block")) == F.col("key"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
            .select("*", F.explode("copy").alias("last")).drop("copy").withColumn("block", F.when(F.col("last") == 1, before).otherwise(F.col("block"))))
    order = Window.partitionBy("block").orderBy("last", "key", "tie")
    return (laid.withColumn("tie", F.xxhash64("text")).withColumn("next_text", F.lead("text").over(order))
            .withColumn("marks", marks(F.col("text"))).withColumn("next_marks", F.lead("marks").over(order))
            .filter("last = 0").select(F.col("id").alias(id_col), "text", "marks", "next_text", "next_marks"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, edited (the last quarter of the code points replaced by as many first ones, or all, of the next text),
    marks, edited_marks, near_edited, near_next. See ``with_next`` for order, nulls and repeated rows."""
    size = F.char_length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = with_next(docs, id_col, text_col).select(id_col, size.cast("long").alias("n_chars"), "marks", "next_marks", F.concat(
        F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"))
    return edited.withColumn("edited_marks", marks(F.col("edited"))).select(
        id_col, "n_chars", "edited", "marks", "edited_marks", likeness(hashes(F.col("marks")), hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(hashes(F.col("marks")), hashes(F.col("next_marks"))).alias("near_next"))
