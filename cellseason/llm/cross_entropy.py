"""Language-model scoring by cross-entropy difference: how much better a target model foretells a document than a background model.

Both are word-pair models over one vocabulary, all different words of the corpus. Words and pairs are counted exactly, each by itself,
however many there are. Documents are dealt to blocks; a block sends each of its different words and pairs once, with its counts, to the
key range that it falls into; a range sums over the blocks and tells each block where the sums differ from the block's own counts. Blocks
and ranges grow in number with the text, so no task and not the driver ever holds a model. A document is scored by what the others
say: its own counts are taken out of both models.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: Bytes of text of a block of documents, and of the documents whose words and pairs one key range answers for, about.
BLOCK_BYTES, RANGE_BYTES = 3 << 20, 16 << 20
#: Share of the pair model; the rest is the word model, in which every word of the vocabulary has ADDED more.
PAIR_SHARE, ADDED = 0.6, 0.5
CACHE = 150_000
#: Stands for the word before the first; it is counted like a word, once a document, but is not one.
START = np.uint64(0x9FB21C651E98DF25)


class WordSlots(dict):
    """Words to their keys: 64-bit hashes. Two of a billion different keys are equal with a chance of 3 %."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        slot = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return slot


def mixed(keys: np.ndarray) -> np.ndarray:
    """One to one, so that also the high bits depend on all bits."""
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return keys ^ (keys >> np.uint64(33))


def slots(text: str | None, known: WordSlots) -> tuple[np.ndarray, np.ndarray]:
    """Of each word (split at white space, in lower case): its key, and the key of the pair of the word before and itself."""
    words = np.fromiter(map(known.__getitem__, (text or "").lower().split()), dtype=np.uint64)
    before = np.concatenate(([START], words[:-1])) if len(words) else words
    return words, mixed(before * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte: all first bytes, all second bytes and so on. High bytes of small numbers so become long runs."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(content: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(content, np.uint8).reshape(8, -1).T).view("<u8").ravel() if content else np.zeros(0, np.uint64)


def counts_to_bytes(counts: np.ndarray) -> bytes:
    """A byte each, 255 for larger ones, which follow in full; nothing if all are 0."""
    if not counts.any():
        return b""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + packed(counts[counts >= 255])


def counts_of_bytes(content: bytes, n: int) -> np.ndarray:
    if not content:
        return np.zeros(n, dtype=np.int64)
    counts = np.frombuffer(content, np.uint8, n).astype(np.int64)
    counts[counts == 255] = unpacked(content[n:]).astype(np.int64)
    return counts


def patch(own: np.ndarray, sums: np.ndarray) -> bytes:
    """Where the sums differ from a block's own counts, and the sums there; nothing if they nowhere do."""
    other = own != sums
    return np.packbits(other).tobytes() + counts_to_bytes(sums[other]) if other.any() else b""


def patched(own: np.ndarray, content: bytes) -> np.ndarray:
    if not content:
        return own
    size = -(-len(own) // 8)
    other = np.unpackbits(np.frombuffer(content, np.uint8, size), count=len(own)).astype(bool)
    out = own.copy()
    out[other] = counts_of_bytes(content[size:], int(other.sum()))
    return out


class Block:
    """The documents of a block in keys: ``sizes`` (words of each), and by kind ("word", with one START a document, and "pair") the different
    keys, ascending, the place among them of each key as it comes, and the counts in target documents and in all."""

    def __init__(self, docs: pa.Table, good: np.ndarray):
        known = WordSlots()
        found = [slots(text.as_py(), known) for text in docs.column("text")]
        self.sizes = np.array([len(f[0]) for f in found], dtype=np.int64)
        self.good = np.isin(docs.column("h").to_numpy(), good)
        none = [np.zeros(0, np.uint64)]
        begin = np.full(int((self.sizes > 0).sum()), START, dtype=np.uint64)
        flags = np.repeat(self.good, self.sizes)
        self.kinds = {}
        for name, keys, own in (("word", np.concatenate([begin, *(f[0] for f in found)]), np.concatenate([self.good[self.sizes > 0], flags])),
                                ("pair", np.concatenate(none + [f[1] for f in found]), flags)):
            different, at, background = np.unique(keys, return_inverse=True, return_counts=True)
            self.kinds[name] = different, at, np.bincount(at[own], minlength=len(different)), background

    def cuts(self, name: str, ranges: int) -> list[int]:
        """Where the keys of each range start, and the end."""
        bounds = np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], dtype=np.uint64)
        keys = self.kinds[name][0]
        return [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]


def count_block(docs: pa.Table, good: pa.Table, ranges: int) -> pa.Table:
    """What a block asks: of each key range that it has keys in, these keys with their counts in target documents and in all."""
    own = Block(docs, good.column("h").to_numpy())
    out: dict[str, list] = {name: [] for name in _ASKED.names}
    cuts = {name: own.cuts(name, ranges) for name in ("word", "pair")}
    for r in range(ranges):
        if not docs.num_rows or all(c[r] == c[r + 1] for c in cuts.values()):
            continue
        out["block"].append(docs.column("block")[0].as_py())
        out["range"].append(r)
        for name, c in cuts.items():
            keys, _, target, background = own.kinds[name]
            part = slice(c[r], c[r + 1])
            out[f"{name}_keys"].append(packed(np.diff(keys[part], prepend=np.uint64(0))))
            out[f"{name}_target"].append(counts_to_bytes(target[part]))
            out[f"{name}_background"].append(counts_to_bytes(background[part]))
    return pa.Table.from_pydict(out, schema=_ASKED)


_COUNTS = [pa.field(f"{kind}_{of}", pa.binary()) for kind in ("word", "pair") for of in ("target", "background")]
_ASKED = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("word_keys", pa.binary()), *_COUNTS[:2], ("pair_keys", pa.binary()), *_COUNTS[2:]])
_TOLD = pa.schema([("block", pa.int64()), ("range", pa.int64()), *_COUNTS, ("n_target", pa.int64()), ("n_background", pa.int64()), ("n_words", pa.int64())])


def sum_range(asked: pa.Table) -> pa.Table:
    """What a range tells each block: where the sums over all blocks differ from the block's, and how many words the range has, all and different ones."""
    out = {"block": asked.column("block"), "range": asked.column("range")}
    for kind in ("word", "pair"):
        own = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) for k in asked.column(f"{kind}_keys")]
        sizes = [len(k) for k in own]
        cuts = [0, *np.cumsum(sizes).tolist()]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        del own
        if kind == "word":
            out["n_words"] = pa.array(np.full(asked.num_rows, len(keys) - int(START in keys)))
        for of in ("target", "background"):
            counts = [counts_of_bytes(c.as_py(), n) for c, n in zip(asked.column(f"{kind}_{of}"), sizes)]
            sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
            out[f"{kind}_{of}"] = pa.array([patch(c, sums[at[i:j]]) for c, i, j in zip(counts, cuts, cuts[1:])], pa.binary())
            if kind == "word":
                out[f"n_{of}"] = pa.array(np.full(asked.num_rows, sums[keys != START].sum()))
    return pa.table({name: out[name] for name in _TOLD.names})


def losses(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """Nats of each word under target (row 0) and background, from counts."""
    plain = (word + ADDED) / (n + ADDED * vocabulary)
    return -np.log(np.where(context > 0, PAIR_SHARE * pair / np.maximum(context, 1) + (1 - PAIR_SHARE) * plain, plain))


def repeats(values: np.ndarray) -> np.ndarray:
    """Of each value how often it comes."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[at]


def score_block(docs: pa.Table, good: np.ndarray, told: pa.Table, ranges: int, n: tuple[int, int], vocabulary: int) -> pa.Table:
    """Scores of the documents of a block from what the ranges tell it."""
    block = Block(docs, good)
    answers = {row["range"]: row for row in told.to_pylist()}
    counts, place = {}, {}
    for name in ("word", "pair"):
        _, place[name], *own = block.kinds[name]
        c = block.cuts(name, ranges)
        counts[name] = np.stack([np.concatenate([patched(o[c[r] : c[r + 1]], answers[r][f"{name}_{of}"] if r in answers else b"") for r in range(ranges)])
                                 for o, of in zip(own, ("target", "background"))]).astype(np.float64)
    begins = int((block.sizes > 0).sum())
    totals, both, first = np.array([[n[0]], [n[1]]], dtype=np.float64), np.zeros((2, len(block.sizes))), 0
    for i, size in enumerate(block.sizes.tolist()):
        if size:
            word, pair = place["word"][begins + first : begins + first + size], place["pair"][first : first + size]
            before = np.concatenate((place["word"][:1], word[:-1]))
            mine = np.array([[float(block.good[i])], [1.0]])  # the counts of the document itself go out of the models that it is in
            own = repeats(word).astype(np.float64)
            both[:, i] = losses(counts["word"][:, word] - mine * own, counts["word"][:, before] - mine * np.concatenate(([1.0], own[:-1])),
                                counts["pair"][:, pair] - mine * repeats(pair), totals - mine * size, vocabulary).mean(axis=1)
        first += size
    none = block.sizes == 0
    columns = [docs.column("id"), pa.array(block.sizes), *[pa.array(x, pa.float64(), mask=none) for x in (both[0], both[1], both[0] - both[1])]]
    return pa.table(columns, names=["id", "n_tokens", "target_loss", "background_loss", "score"])


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, n_tokens, target_loss, background_loss, score (their difference per token; low: like the target).

    The background model counts all documents, the target model those whose id is in ``target_ids`` (first column; repeated and null
    ids do no harm); a document's losses leave out its own counts. Both have the same order, smoothing and vocabulary. Null texts count
    as empty; documents without words have null losses and score. Without other target documents the target model is uniform. Repeated
    rows are counted and scored one by one, each by all others. No documents give no rows; other columns are ignored. The text moves once:
    both uses of the dealt documents read the same exchange. Blocks follow the hash of id and text, so only rows equal in both share one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, ranges = max(2 * partitions(docs), -(-size // BLOCK_BYTES)), max(partitions(docs), 2, -(-size // RANGE_BYTES))
    block = F.pmod(F.col("h"), F.lit(blocks)).cast("long").alias("block")
    hashed = F.xxhash64("id", "text").alias("h")
    dealt = rows.select("id", "text", hashed).select("*", block)
    wanted = target_ids.select(F.col(target_ids.columns[0]).try_cast(kind).alias("id")).filter("id is not null").distinct()
    good = rows.select("id", hashed).join(wanted, "id", "left_semi").select("h").distinct().select("h", block)

    columns = lambda schema: ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in schema)
    asked = dealt.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(lambda left, right: count_block(left, right, ranges), columns(_ASKED))
    told = stored(asked.groupBy("range").applyInArrow(sum_range, columns(_TOLD)), "told")
    by_range = told.groupBy("range").agg(*[F.max(c).alias(c) for c in ("n_target", "n_background", "n_words")])
    n = by_range.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_target", "n_background", "n_words")]).first()

    # answers and target rows of a block come in one table: rows with h are target rows
    back = told.drop("n_target", "n_background", "n_words").withColumn("h", F.lit(None).cast("long")).unionByName(good, allowMissingColumns=True)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        marked = pc.is_valid(right.column("h"))
        return score_block(left, right.filter(marked).column("h").to_numpy(), right.filter(pc.invert(marked)), ranges, (n.n_target, n.n_background), n.n_words)

    found = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judge, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return found.withColumnRenamed("id", id_col)
