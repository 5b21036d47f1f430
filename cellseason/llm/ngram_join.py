"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents of the same shingle set are one class. Every tree of the forest sorts the classes by a label of MinHash values; classes that
share a prefix of the label are candidates. Matched prefixes are shortened until pairs at the threshold are found with the target
recall. Candidates are verified on their shingle sets, block against block, and each linked pair counts in the first tree that joins it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_rows, partitions

GRAM, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.99999
#: Classes of a block in the verification of a large bucket.
BLOCK = 400
CACHE = 150_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint32(0x9E3779B1)


def found_share(similarity: float, depth: int, trees: int) -> float:
    """Chance that some tree joins a pair of this similarity at this depth."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """From full labels on, shortened until pairs at the threshold (the hardest ones) are found with the target recall."""
    while depth > 1 and found_share(threshold, depth, trees) < recall:
        depth -= 1
    return depth


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, known: WordHashes, gram: int = GRAM) -> np.ndarray:
    """Sorted different hashes of runs of ``gram`` words (split at white space, in lower case); fewer words, but not none, are one run."""
    words = np.fromiter(map(known.__getitem__, (text or "").lower().split()), dtype=np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - gram + 1)
    run = np.full(n, min(len(words), gram), dtype=np.uint64)
    for i in range(min(len(words), gram)):
        run = (run ^ words[i : i + n]) * _M1
        run ^= run >> np.uint64(29)
    return np.unique(run * _M2)


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


class Forest:
    """Labels of all trees: for each tree ``depth`` MinHash values of two bytes."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(6)
        self.a = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def label(self, found: np.ndarray) -> bytes:
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        high = (found >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(high), 512):
            least = np.minimum(least, ((high[i : i + 512, None] ^ self.b) * self.a).min(axis=0))
        return ((least * _M3) >> np.uint32(16)).astype(">u2").tobytes()


def linked_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of similarity ``threshold`` or more, by exact counts of common shingles."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # in one set only: in no intersection
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width, total = 2048, int(column[-1]) + 1 if len(column) else 0
    for low in range(0, total, width):
        i, j = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), min(width, total - low)), dtype=np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        common += part @ part.T
    with np.errstate(invalid="ignore"):
        near = common / (sizes[:, None] + sizes[None, :] - common) >= threshold
    return np.nonzero(np.triu(near, 1))


def verify_block(rows: list[dict], tree: int, depth: int, threshold: float) -> dict[bytes, list]:
    """Of the rows of a block that have a link: how many documents they are linked with here, and the least class linked with them."""
    a, b = linked_pairs([r["shingles"] for r in rows], threshold)
    chunk = np.array([r["chunk"] for r in rows])
    if rows[0]["lo"] != rows[0]["hi"]:  # pairs inside a chunk have a block of their own
        across = chunk[a] != chunk[b]
        a, b = a[across], b[across]
    labels = np.array([np.frombuffer(r["label"], dtype=">u2") for r in rows]).reshape(len(rows), -1, depth)
    first = (labels[a] == labels[b]).all(axis=2).argmax(axis=1) == tree
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i]["class"])
    rank = {i: n for n, i in enumerate(order)}
    links = [0] * len(rows)
    for i, j in zip(a[first].tolist(), b[first].tolist()):
        links[i] += rows[j]["copies"]
        links[j] += rows[i]["copies"]
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y, key=rank.__getitem__)] = min(x, y, key=rank.__getitem__)
    return {rows[i]["class"]: [n, rows[top(i)]["class"]] for i, n in enumerate(links) if n}


def least_members(edges: DataFrame) -> DataFrame:
    """u, root: of every node of the edges (u, v) the least node of its connected part; large-star and small-star in turn.

    The second join key makes both sides of a join a shuffle of its own, which adaptive execution can split at a hub."""
    edges = cut_lineage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        edges = both.withColumn("k", F.xxhash64("u")).join(low.withColumn("k", F.xxhash64("u")), ["k", "u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.withColumn("k", F.xxhash64("u")).join(low.withColumn("k", F.xxhash64("u")), ["k", "u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD,
                trees: int = TREES, recall: float = RECALL, hashes: bool = False) -> DataFrame:
    """One row a document: ``id_col``, class_id, copy_id, n_copies, n_links; with ``hashes`` also text_hash and class_hash, the hash of
    its text and of the text that stands for its group, so that rows of one id and unlike texts are told apart.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is ``threshold`` or more. ``n_links``: with how
    many other documents (rows) it is linked; ``class_id``: the least id that it is connected with by links, its own if none;
    ``copy_id``, ``n_copies``: least id and number of the documents with its very set. Null and empty texts have no n-gram and no link.
    A null id is no least id unless there is no other. Repeated rows count as copies. Copies are counted, never paired; pairs of
    different texts are counted inside tasks. A pair at the threshold is missed with a chance of at most 1 - ``recall``.
    No documents give no rows; other columns are ignored; whole texts count, however long.
    """
    depth = prefix_length(threshold, recall, trees)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def sign():
        known, forest = WordHashes(), Forest(trees, depth)

        def run(batch):
            found = [shingles(t, known, gram) for t in batch["text"]]
            return {"id": batch["id"], "hash": batch["hash"], "class": [set_key(f) if len(f) else None for f in found],
                    "label": [forest.label(f) if len(f) else None for f in found]}

        return run

    signed = cut_lineage(map_rows(source, sign, f"id {kind}, hash long, class binary, label binary"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "hash"))  # the row whose text stands for the class
    classes = cut_lineage(signed.filter("class is not null").groupBy("class").agg(F.count("*").alias("copies"), first.alias("first"), F.min("label").alias("label"))
                          .select("class", "copies", F.col("first.id").alias("low"), F.col("first.hash").alias("low_hash"), "label"))

    # Leaves are many: classes and nodes go as 64-bit hashes. Where two fall together, more candidates are verified, no more.
    classes_c = classes.withColumn("c", F.xxhash64("class"))
    leaves = classes_c.select("c", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "label").select(
        "c", "tree", F.xxhash64("tree", F.substring("label", F.col("tree") * (2 * depth) + 1, F.lit(2 * depth))).alias("node"))
    nodes = (leaves.groupBy("node").agg(F.min("tree").alias("tree"), F.count("*").alias("n"), F.bit_xor("c").alias("x"), F.bit_xor(F.xxhash64("c")).alias("y"))
             .filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("tree", "node")).alias("kept")))  # of equal buckets the first tree's
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    seats = (leaves.select("c", "node").join(nodes.select("kept.*", "n"), "node").withColumn("chunk", F.pmod(F.xxhash64("c", F.lit(2)), chunks).cast("int"))
             .select("c", "tree", "node", "chunk", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
             .groupBy("c").agg(F.collect_list(F.struct("tree", "node", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk")).alias("seats")))
    block = ["node", "lo", "hi"]
    work = (source.join(seats.join(classes_c, "c"), (F.col("hash") == F.col("low_hash")) & F.col("id").eqNullSafe(F.col("low"))).dropDuplicates(["class"])
            .select("class", "label", "copies", "text", F.explode("seats").alias("seat")).select("seat.*", "class", "label", "copies", "text")
            .repartition(partitions(docs), *block).sortWithinPartitions(*block))
    result = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def verify(batches):
        rows: list[dict] = []
        known = WordHashes()

        def done():
            own = {}
            for row in rows if len(rows) > 1 else []:
                found = shingles(row.pop("text"), known, gram)
                if set_key(found) == row["class"]:
                    own[row["class"]] = row | {"shingles": found}
            found = verify_block([*own.values()], rows[0]["tree"], depth, threshold) if len(own) > 1 else {}
            return pa.RecordBatch.from_pydict({"class": [*found], "links": [f[0] for f in found.values()], "root": [f[1] for f in found.values()]}, schema=result)

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                for row in batch.slice(start, BLOCK).to_pylist():
                    if rows and any(row[c] != rows[0][c] for c in block):
                        yield done()
                        rows.clear()
                    rows.append(row)
        if rows:
            yield done()

    linked = cut_lineage(work.mapInArrow(verify, "class binary, links long, root binary"))
    roots = least_members(linked.select(F.col("class").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "class")
    counted = classes.select("class", "copies", "low", "low_hash").join(linked.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(roots, "class", "left")
    counted = counted.filter("copies > 1 or links is not null").withColumn("root", F.coalesce("root", "class"))
    lows = counted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "low_hash")).alias("least"))
    lows = lows.select("root", F.col("least.low").alias("class_id"), F.col("least.low_hash").alias("class_hash"))
    table = counted.join(lows, "root").select("class", "class_id", "class_hash", F.col("low").alias("copy_id"), F.col("copies").alias("n_copies"),
                                              (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lone = signed.select("id", "hash", F.coalesce("class", F.encode(F.concat(F.lit("no words "), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8")).alias("class"))
    more = [F.col("hash").alias("text_hash"), F.coalesce("class_hash", "hash").alias("class_hash")] if hashes else []
    return lone.join(table, "class", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)


def keep_one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of ``groups`` (``near_groups`` with hashes): the one that stands for it, known by its id and the hash of
    its text, so rows of one id and unlike texts stay or go by themselves. Documents without words all stay. Of repeated rows (same
    id and text, null ids too) one stays."""
    stays = F.col(id_col).eqNullSafe(F.col("class_id")) & F.col("text_hash").eqNullSafe(F.col("class_hash"))
    gone = groups.filter(~stays).select(F.col(id_col).alias("gone_id"), F.xxhash64(id_col, "text_hash").alias("gone_key")).distinct()
    # one key, so that texts are exchanged once for both steps; ids are compared beside it
    keyed = docs.withColumn("row_key", F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    same = F.coalesce(F.col(id_col) == F.col("gone_id"), F.col(id_col).isNull() & F.col("gone_id").isNull())
    return keyed.join(gone, (F.col("row_key") == F.col("gone_key")) & same, "left_anti").dropDuplicates(["row_key", id_col, text_col]).drop("row_key")
