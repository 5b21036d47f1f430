"""Ranked lexical search by dense blocked multiplication: item weights times document impacts, tile by tile.

Weights and impacts are whole numbers. A tile of the items' own vocabulary is as wide as keeps every sum of products below 2^53, so
float64 products are exact; sums of several tiles are added as 64-bit integers. Each task keeps the best documents of every item and drops
the rest tile by tile; ties at the edge are kept until their ids decide.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

#: Documents and vocabulary entries of a tile of impacts, and items of a tile of weights, at most: 8 MB and 4 MB.
DOCS, TERMS, ITEMS = 512, 2048, 256
#: Text of the items of one pass over the documents, in bytes, at most (or one item). A larger set takes more passes.
ITEM_BYTES = 16 << 20
#: An impact is at most this; products and their sums stay below EXACT.
TOP_IMPACT, EXACT = 10**6, 2**53
#: Bytes of a text that are split at once.
PIECE = 1 << 20

# Bytes of terms stay (A-Z lower-cased), every other byte becomes a space. In UTF-8, non-ASCII characters only have high bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: str | None):
    """Lists of the terms of a text; the text is cut between terms, so that long ones need little memory."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n (terms of the document), terms and tfs: the entries of the vocabulary that occur in it, ascending, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ids = pa.list_(pa.int32())

    def run(batches):
        find = shared.value.get
        for batch in batches:
            sizes, offsets, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                n, found = 0, Counter()
                for part in pieces(text.as_py()):
                    n += len(part)
                    found.update(map(find, part))
                found.pop(None, None)
                own = sorted(found)
                sizes.append(n)
                terms += own
                tfs += [found[t] for t in own]
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())).cast(ids) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


class Best:
    """The best documents of every item so far: all that are not surely behind ``k`` others."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.kept, self.room = k, np.ones(items, dtype=np.int64), None, 0

    def add(self, scores: np.ndarray, first: int, ids: pa.Array) -> None:
        """Scores of a tile: items from ``first`` on, documents ``ids``. Equal scores at the edge stay in."""
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if len(item):
            found = pa.table({"item": item + first, "score": scores[item, doc], "id": ids.take(pa.array(doc))})
            self.kept = found if self.kept is None else pa.concat_tables([self.kept, found])
            if self.kept.num_rows > self.room:
                self.cut()

    def cut(self) -> None:
        rows = self.kept.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
        item = rows.column("item").to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = rows.column("score").to_numpy()[last]
        self.kept = rows.filter(pa.array(place < self.k)).combine_chunks()
        self.room = 2 * self.kept.num_rows + 100_000

    def rows(self) -> pa.Table | None:
        if self.kept is not None:
            self.cut()
        return self.kept


def impacts(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each occurring entry of the vocabulary: the entry, the document (its place in the batch), its impact."""
    m = np.array([50 + 50 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], dtype=np.int64)
    doc = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())
    tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
    return batch.column("terms").flatten().to_numpy(), doc, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])


def item_tiles(entries: list[list[int]], weights: list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of ITEMS items: first item, items, the tile's own vocabulary (ascending), and of its weights the item, the column, the value."""
    out = []
    for first in range(0, len(entries), ITEMS):
        part = entries[first : first + ITEMS]
        terms = np.array([t for own in part for t in own], dtype=np.int64)
        own, column = np.unique(terms, return_inverse=True)
        rows = np.repeat(np.arange(len(part)), [len(x) for x in part])
        out.append((first, len(part), own, rows, column, np.array([weights[t] for t in terms.tolist()], dtype=np.float64)))
    return out


def tile_scores(tile, terms: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, width: int) -> np.ndarray:
    """Scores of a tile of items in a tile of documents: one dense product for each ``width`` columns of the vocabulary."""
    _, items, own, row, column, value = tile
    scores = np.zeros((items, docs), dtype=np.int64)
    at = np.searchsorted(own, terms)
    known = own[np.minimum(at, len(own) - 1)] == terms if len(own) else np.zeros(len(terms), dtype=bool)
    at, doc, impact = at[known], doc[known], impact[known]
    for start in range(0, len(own), width):
        n = min(width, len(own) - start)
        here, there = (at >= start) & (at < start + n), (column >= start) & (column < start + n)
        dense, w = np.zeros((n, docs)), np.zeros((items, n))
        dense[at[here] - start, doc[here]] = impact[here]
        w[row[there], column[there] - start] = value[there]
        scores += (w @ dense).astype(np.int64)
    return scores


def best_of_tiles(counted: DataFrame, entries: list[list[int]], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (number), id, score: at most ``k`` rows an item of each task, all with a score above 0."""
    width = max(1, min(TERMS, (EXACT - 1) // (TOP_IMPACT * max([1, *weights]))))
    shared = counted.sparkSession.sparkContext.broadcast((item_tiles(entries, weights), len(entries)))

    def run(batches):
        tiles, items = shared.value
        best = Best(items, k)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS):
                batch = whole.slice(start, DOCS)
                found = impacts(batch, n_docs, n_terms)
                for tile in tiles:
                    best.add(tile_scores(tile, *found, batch.num_rows, width), tile[0], batch.column("id"))
        rows = best.rows()
        if rows is not None:
            yield from rows.select(["item", "id", "score"]).to_batches()

    return counted.mapInArrow(run, f"item long, id {counted.schema['id'].dataType.simpleString()}, score long")


def passes(items: DataFrame) -> list[DataFrame]:
    """The items in as many parts as keep the text of each within ITEM_BYTES (or at one item)."""
    size, count, n = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.count("*"), 1
    while True:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        largest = items.groupBy(part.alias("part")).agg(size.alias("size"), count.alias("count")).filter(F.col("count") > 1).agg(F.max("size")).first()[0]
        if (largest or 0) <= ITEM_BYTES:
            return [items.filter(part == p) for p in range(n)]
        n = 2 * n


def _best(rows: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item with a score above 0: ``item_col``, rank (from 1), ``id_col``, score.

    Equal scores rank by ascending id, a null id last. Null and empty texts have no terms: such documents are found by no item, such items
    find none. Repeated documents rank one by one; items equal in id and text are one item. No documents or no items give no rows. Other
    columns are ignored. Texts are read once for each pass over the items; whole texts count, in pieces of bounded memory.
    The items of a pass, at most ITEM_BYTES of text, go to all tasks; what a task gives back is at most ``k`` rows an item.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    questions = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct()
    found = [_search(rows, part, k) for part in passes(questions)]
    kind = items.schema[item_col].dataType.simpleString()
    none = docs.sparkSession.createDataFrame([], f"item {kind}, rank int, id {rows.schema['id'].dataType.simpleString()}, score long")
    out = none
    for part in found:
        out = part if out is none else out.unionByName(part)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()  # bounded by ITEM_BYTES
    terms = [sorted({t for part in pieces(r.text) for t in part}) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
    counted = stored(count_terms(docs, vocabulary), "lexical")
    size = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    dfs = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = [weight(dfs.get(i, 0), size.docs or 0) for i in range(len(vocabulary))]
    entries = [[vocabulary[t] for t in own] for own in terms]
    best = best_of_tiles(counted, entries, weights, size.docs or 0, max(1, size.terms or 0), k)
    salt = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(partitions(docs)))))
    best = _best(_best(best.withColumn("salt", salt), ["item", "salt"], k).drop("rank"), ["item"], k)
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"item long, name {items.schema['item'].dataType.simpleString()}")
    return best.join(names, "item").select(F.col("name").alias("item"), "rank", "id", "score")
