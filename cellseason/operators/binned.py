"""Forests and boosting over binned rows: tasks count, Spark adds the counts of a node up and a task judges them, the driver keeps the cuts.

A feature has at most 32 bins between cut points, a row is one byte for each of them; rows travel in blocks. ``rows`` have ``x`` (array),
``code`` and ``key`` (what bags and samples are drawn by). Nodes have heap numbers (root 1, children 2n and 2n + 1); ``feature`` is -1 where a
node has no cut, and a bin above ``cut`` goes right."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import matrix
from .order import stored

# the functions travel to the executors, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
CHUNK = 1 << 17
SMALL = 1 << 19  # nodes of at most as many rows are finished by one task
POISSON = (np.cumsum([1 / float(np.prod(np.arange(1, i + 1))) for i in range(12)]) / np.e * 2.0 ** 32).astype(np.uint64)


def cut_points(rows: DataFrame, width: int, n: int, bins: int = BINS, sample: int = 1 << 16, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """Cuts between the bins of each feature: between all values where they are few, else near equal shares of the rows; with the ``weights`` of
    their codes by Spark ML's rule: where a value weighs several shares, those that follow it are cut one by one.

    Only these places come from a sample (about ``sample`` rows by their key, all if fewer; Spark ML takes 10,000)."""
    part = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    got = part.select("x", "code").toArrow()
    x, cuts = matrix(got["x"].combine_chunks(), width), []
    w = None if weights is None else weights[got["code"].to_numpy()]
    for f in range(width):
        v, at, many = np.unique(x[:, f], return_inverse=True, return_counts=True)
        between = (v[1:] + v[:-1]) / 2
        if len(between) >= bins:
            if w is not None:
                cuts.append(between[spark_places(np.bincount(at, w), bins)])
                continue
            upto = many.cumsum()[:-1]
            near = len(x) * np.arange(1, bins) / bins
            at = np.searchsorted(upto, near).clip(1, len(upto) - 1)
            between = between[np.unique(np.where(near - upto[at - 1] < upto[at] - near, at - 1, at))]
        cuts.append(between)
    return cuts


def spark_places(weight: np.ndarray, bins: int) -> list[int]:
    """After which of the ascending values Spark ML cuts: where the running weight is nearest to the next share, each value once."""
    upto = weight.cumsum()
    middle, share = (upto[:-1] + upto[1:]) / 2, upto[-1] / bins
    found, target, at = [], share, 0
    while (at := max(at, int(np.searchsorted(middle, target, "right")))) < len(middle):
        found.append(at)
        target, at = target + share, at + 1
    return found


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins by row (line) and feature (column)."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f])
    return out


def blocks(rows: DataFrame, width: int, cuts: list[np.ndarray]) -> DataFrame:
    """Stage table of the binned rows, one line for many of them, dealt evenly over the cores."""
    def run(batches):
        for b in batches:
            parts = [binned(matrix(b.column("x"), width), cuts), b.column("code").to_numpy().astype(np.uint8), b.column("key").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["bins", "code", "key"])

    made = rows.mapInArrow(run, "bins binary, code binary, key binary")
    return stored(made.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def chunks(batches, width: int, *more: str):
    """Bins, codes and what else is asked for (8-byte items) of up to ``CHUNK`` rows or one block."""
    held, n = [], 0
    def joined():
        return [np.concatenate([h[i] for h in held], axis=-1 if i else 0) for i in range(len(held[0]))]
    for b in batches:
        for i in range(b.num_rows):
            at = lambda c: np.frombuffer(b.column(c)[i].as_buffer(), np.uint8)
            code = at("code")
            if held and n + len(code) > CHUNK:
                yield joined()
                held, n = [], 0
            held.append([at("bins").reshape(-1, width), code, *[at(c).view(np.uint64).reshape(-1, len(code)) for c in more]])
            n += len(code)
    if held:
        yield joined()


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int, lines: np.ndarray | None = None) -> np.ndarray:
    """Heap number of the node of one tree that each row (or those at ``lines``) has reached."""
    n, width = bins.shape
    at, flat = (np.arange(n) if lines is None else lines) * width, bins.ravel()
    node, feature = np.ones(len(at), np.int64), feature.astype(np.int64)
    for _ in range(steps):
        f = feature[node]
        right = flat.take(at + np.maximum(f, 0)) > cut[node]
        node = np.where(f >= 0, 2 * node + right, node)
    return node


def mixed(*parts) -> np.ndarray:
    """64 well mixed bits of whole numbers (arrays that broadcast)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) ^ h
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def judged(parts: DataFrame, judge, schema: str) -> pa.Table:
    """What ``judge`` says of the sum of all arrays ``v`` of a ``slot``."""
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in table["v"])
        return pa.table({"slot": table["slot"][:1].combine_chunks(), **{c: [x] for c, x in judge(table["slot"][0].as_py(), total).items()}})

    return parts.groupBy("slot").applyInArrow(run, schema).toArrow()


def sums_by_slot(slots, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=["slot", "v"])


# --- forest -------------------------------------------------------------------------------------------

def drawn(tree, node, width: int, many: int, seed: int) -> np.ndarray:
    """Features that nodes may cut by, ``many`` different ones for each."""
    if many >= width:
        return np.tile(np.arange(width), (len(node), 1))
    lot = mixed(seed, np.asarray(tree)[:, None], np.asarray(node)[:, None], np.arange(width))
    return np.sort(np.argpartition(lot, many, axis=1)[:, :many], axis=1)


def class_counts(bins, lines, code, bag, slot, features, k: int) -> np.ndarray:
    """Rows by slot, drawn feature, bin and class."""
    at, flat, size = lines * bins.shape[1], bins.ravel(), len(features) * BINS * k
    base, bag, out = slot * (BINS * k) + code, bag.astype(np.float64), []
    for of in features.T.copy():
        v = flat.take(at + of[slot]).astype(np.int64)
        out.append(np.bincount(base + v * k, bag, size).reshape(len(features), BINS, k))
    return np.stack(out, 1)


def best_gini(counts: np.ndarray, features: np.ndarray, weights: np.ndarray):
    """Cut of each slot with the largest fall of the weighted Gini impurity: feature (-1: none falls), bin, rows by class left and right."""
    left = counts.cumsum(2)
    right = left[:, :, -1:] - left
    purity = lambda a: (a * a).sum(-1) / np.maximum(a.sum(-1), 1e-300)
    whole = left[:, :1, -1] * weights
    gain = purity(left * weights) + purity(right * weights) - purity(whole)[..., None]
    gain = np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), gain, 0.0).reshape(len(counts), -1)
    best, every = gain.argmax(1), np.arange(len(counts))
    j, b = best // BINS, best % BINS
    cuts = gain[every, best] > 1e-12 * whole.sum((1, 2))
    return np.where(cuts, features[every, j], -1), b, left[every, j, b].astype(np.int64), right[every, j, b].astype(np.int64)


def subtree(bins, code, bag, tree: int, root: int, depth: int, many: int, seed: int, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of the tree below ``root``, grown on its rows alone. Rows stay sorted by node, so that the counts of a node are written together."""
    width, k = bins.shape[1], len(weights)
    nodes, slot = np.array([root]), np.zeros(len(code), np.int64)
    own = np.bincount(code, bag, k).astype(np.int64)[None]
    found = []
    for level in range(root.bit_length() - 1, depth + 1):
        f, cut = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        mixed_up = (own > 0).sum(1) > 1  # a pure node ends
        if level == depth or not mixed_up.any():
            found.append((nodes, f, cut, own))
            break
        features = drawn(np.full(len(nodes), tree), nodes, width, many, seed)
        lines = np.arange(len(code))
        best, at, left, right = best_gini(class_counts(bins, lines, code, bag, slot, features, k), features, weights)
        f[mixed_up], cut[mixed_up] = best[mixed_up], at[mixed_up]
        found.append((nodes, f, cut, own))
        split = f >= 0
        if not split.any():
            break
        side = bins.ravel().take(lines * width + np.maximum(f, 0)[slot]) > cut[slot]
        slot = np.where(split[slot], 2 * (split.cumsum() - 1)[slot] + side, 2 * len(nodes))
        order = np.argsort(slot.astype(np.uint16), kind="stable") if 2 * len(nodes) < 1 << 16 else np.argsort(slot, kind="stable")
        order = order[:np.searchsorted(slot[order], 2 * len(nodes))]
        bins, code, bag, slot = bins[order], code[order], bag[order], slot[order]
        nodes = np.stack([2 * nodes[split], 2 * nodes[split] + 1], 1).ravel()
        own = np.stack([left[split], right[split]], 1).reshape(-1, k)
    nodes, f, cut, own = (np.concatenate(p) for p in zip(*found))
    return {"tree": np.full(len(nodes), tree), "node": nodes, "f": f, "cut": cut, **{f"n{i}": own[:, i] for i in range(k)}}


def grow_forest(table: DataFrame, width: int, weights: np.ndarray, n: int, first: int, end: int, depth: int, many: int, seed: int, bagged: bool, small: int = SMALL):
    """Trees ``first`` to ``end`` over ``blocks``: ``(feature, cut, counts)`` by tree and heap number.

    Large nodes of all trees are cut level by level from counts that are added up over the tasks; the rows of nodes with at most ``small``
    rows are sent to one task each, which finishes the node."""
    trees, k, size = end - first, len(weights), 2 << depth
    feature, cut = np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.uint8)
    counts = np.zeros((trees, size, k), np.int64)
    step = width + 2

    def bag_of(key, t):
        drawn = mixed(seed, first + t, key[0]) >> np.uint64(32)
        return np.searchsorted(POISSON, drawn, side="right").astype(np.uint8) if bagged else np.ones(key.shape[1], np.uint8)

    def members(chunk, t, number, feature, cut, steps):
        """Lines, numbers and bags of the rows of a tree that are in numbered nodes."""
        bag = bag_of(chunk[2], t)
        lines = np.nonzero(bag)[0]
        slot = number[t, walk(chunk[0], feature[t], cut[t], steps, lines)]
        keep = slot >= 0
        return lines[keep], slot[keep], bag[lines[keep]]

    level, open_, few = 0, [(t, 1) for t in range(trees)] if n > small else [], [] if n > small else [(t, 1) for t in range(trees)]
    while open_:
        tree, node = np.array(open_).T
        features = drawn(first + tree, node, width, many, seed)
        number, start = np.full((trees, size), -1, np.int64), np.searchsorted(tree, np.arange(trees + 1))
        number[tree, node] = np.arange(len(tree)) - start[tree]  # within the tree

        def tally(batches, feature=feature.copy(), cut=cut.copy(), number=number, features=features, start=start, steps=level):
            total = np.zeros((len(features), many, BINS, k))
            for chunk in chunks(batches, width, "key"):
                for t in np.nonzero(np.diff(start))[0]:
                    lines, slot, bag = members(chunk, t, number, feature, cut, steps)
                    here = slice(start[t], start[t + 1])
                    total[here] += class_counts(chunk[0], lines, chunk[1][lines], bag, slot, features[here], k)
            seen = np.nonzero(total.any((1, 2, 3)))[0]
            yield sums_by_slot(seen, total[seen])

        def judge(slot, total, features=features):
            f, b, left, right = (a[0] for a in best_gini(total.reshape(1, many, BINS, k), features[slot:slot + 1], weights))
            own = total.reshape(many, BINS, k)[0].sum(0)
            return {"f": f, "cut": b, **{f"n{i}": own[i] for i in range(k)}, **{f"l{i}": left[i] for i in range(k)}}

        schema = ", ".join(["slot bigint", "f bigint", "cut bigint", *[f"n{i} double" for i in range(k)], *[f"l{i} bigint" for i in range(k)]])
        got = judged(table.mapInArrow(tally, "slot bigint, v binary"), judge, schema)
        column = lambda c: np.stack([got[f"{c}{i}"].to_numpy() for i in range(k)], 1).astype(np.int64)
        at, own, left = got["slot"].to_numpy(), column("n"), column("l")
        t, m, f = tree[at], node[at], got["f"].to_numpy()
        feature[t, m], cut[t, m], counts[t, m] = f, got["cut"].to_numpy(), own
        t, m, own, left = t[f >= 0], m[f >= 0], own[f >= 0], left[f >= 0]
        counts[t, 2 * m], counts[t, 2 * m + 1] = left, own - left
        level += 1
        below = sorted(zip(np.tile(t, 2).tolist(), np.concatenate([2 * m, 2 * m + 1]).tolist()))
        below = [b for b in below if (counts[b] > 0).sum() > 1] if level < depth else []
        open_ = [b for b in below if counts[b].sum() > small]
        few += [b for b in below if counts[b].sum() <= small]
    if few:
        number = np.full((trees, size), -1, np.int64)
        number[tuple(np.array(few).T)] = np.array(few)[:, 1]

        def send(batches, feature=feature.copy(), cut=cut.copy()):
            for chunk in chunks(batches, width, "key"):
                lying = np.column_stack(chunk[:2])
                for t in range(trees):
                    lines, slot, bag = members(chunk, t, number, feature, cut, level)
                    order = np.argsort(slot, kind="stable")
                    slot, data = slot[order], np.column_stack([lying[lines[order]], bag[order]])
                    at = np.nonzero(np.diff(slot, prepend=-1))[0]
                    if len(at):
                        ends = np.append(at[1:], len(slot))
                        yield sums_by_slot(t * size + slot[at], [data[a:b] for a, b in zip(at, ends)])

        def finish(part: pa.Table) -> pa.Table:
            t, root = divmod(part["slot"][0].as_py(), size)
            data = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, step) for v in part["v"]])
            bins, code, bag = np.ascontiguousarray(data[:, :width]), data[:, width].astype(np.int64), data[:, width + 1].astype(np.float64)
            return pa.table(subtree(bins, code, bag, first + t, root, depth, many, seed, weights))

        schema = ", ".join(["tree bigint", "node bigint", "f bigint", "cut bigint", *[f"n{i} bigint" for i in range(k)]])
        got = table.mapInArrow(send, "slot bigint, v binary").groupBy("slot").applyInArrow(finish, schema).toArrow()
        t, m = got["tree"].to_numpy() - first, got["node"].to_numpy()
        feature[t, m], cut[t, m] = got["f"].to_numpy(), got["cut"].to_numpy()
        counts[t, m] = np.stack([got[f"n{i}"].to_numpy() for i in range(k)], 1)
    return feature, cut, counts


def pruned(feature: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Features without the cuts whose two sides are leaves of the same class, from below."""
    feature, vote = feature.copy(), (counts * weights).argmax(-1)
    for level in reversed(range(feature.shape[1].bit_length() - 2)):
        m = np.arange(1 << level, 2 << level)
        idle = (feature[:, m] >= 0) & (feature[:, 2 * m] < 0) & (feature[:, 2 * m + 1] < 0) & (vote[:, 2 * m] == vote[:, 2 * m + 1])
        feature[:, m] = np.where(idle, -1, feature[:, m])
    return feature


def forest_shares(cuts, feature, cut, shares, depth: int):
    """Arrow function of the feature arrays: class shares of the leaves of a row, averaged over the trees."""
    def of(x: pa.Array) -> pa.Array:
        b = binned(matrix(x, len(cuts)), cuts)
        p = np.zeros((len(x), shares.shape[-1]))
        for t in range(len(feature)):
            p += shares[t, walk(b, feature[t], cut[t], depth)]
        p /= p.sum(1, keepdims=True)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

    return F.arrow_udf(of, "array<double>")
