"""Sums over Arrow batches, for models: tasks add up what their rows give, Spark adds the tasks up, the driver keeps the model that grows.

Trees: nodes have heap numbers (root 1, children 2n and 2n + 1). A task walks its rows down the cuts found so far, so that nothing is written
or exchanged for a row between two levels; what is exchanged is one row a task and open node. ``matrix`` and ``descend`` are all that
runs for each row besides the counting."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the functions travel to the executors, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long arrays without NULLs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """Heap number of the node that each row (line) has reached in each tree (column); ``feature`` is -1 where a tree has no cut."""
    trees = np.arange(len(feature))
    node = np.ones((len(x), len(feature)), np.int64)
    for _ in range(steps):
        f = feature[trees, node]
        right = np.take_along_axis(x, np.maximum(f, 0), axis=1) > cut[trees, node]
        node = np.where(f >= 0, 2 * node + right, node)
    return node


def added(rows: DataFrame, tally: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], how: dict[str, str]) -> pa.Table:
    """One row for each ``slot`` that a task has counted: the columns of ``tally`` (one call a task), put together by sum, min or max.
    ``how`` says by which; columns that are summed as whole numbers stand in capitals (SUM)."""
    types = {"sum": "double", "SUM": "bigint", "min": "double", "max": "double"}

    def run(batches):
        found = tally(batches)
        yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in ("slot", *how)], names=["slot", *how])

    parts = rows.mapInArrow(run, ", ".join(["slot bigint", *[f"{c} {types[h]}" for c, h in how.items()]]))
    of = {"sum": F.sum, "SUM": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy("slot").agg(*[of[h](c).alias(c) for c, h in how.items()]).toArrow()


def grow_random(rows: DataFrame, width: int, weights: np.ndarray, root: np.ndarray, features: np.ndarray, draws: np.ndarray, depth: int):
    """Extremely randomised trees over ``rows`` (``x`` array, ``code``): ``(feature, cut, gain, shares)`` by tree and heap number.

    ``features`` (tree, node, place; -1: none) are the features that a node draws and ``draws`` where in its range each is cut. A level takes
    one scan for the ranges and one for the classes on both sides of the cuts; ``root`` has the rows of each class."""
    trees, size, many = features.shape
    k = len(weights)
    feature, cut, gains = np.full((trees, 2 * size), -1, np.int64), np.zeros((trees, 2 * size)), np.zeros((trees, 2 * size))
    counts = np.full((trees, 2 * size, k), -1, np.int64)
    counts[:, 1] = root
    purity = lambda a: (a * a).sum(-1) / np.maximum(a.sum(-1), 1e-300)
    for level in range(depth):
        here = slice(1 << level, 2 << level)
        tree, node = np.nonzero((counts[:, here] > 0).sum(-1) > 1)  # a pure node ends
        if not len(tree):
            break
        node += 1 << level
        number = np.full((trees, 2 * size), -1, np.int64)
        number[tree, node] = np.arange(len(tree))
        drawn = features[tree, node]

        def members(batch, feature=feature, cut=cut, number=number, drawn=drawn, level=level):
            """Slots, values and lines of the rows that are in open nodes, one for each drawn feature."""
            x = matrix(batch.column("x"), width)
            found = number[np.arange(trees), descend(x, feature, cut, level)]
            line, of = np.nonzero(found >= 0)
            found = found[line, of]
            f = drawn[found]
            keep = (f >= 0).ravel()
            slot = (found[:, None] * many + np.arange(many)).ravel()[keep]
            return slot, x[line[:, None], f].ravel()[keep], np.repeat(line, many)[keep]

        def ranges(batches, members=members, slots=len(tree) * many):
            lo, hi = np.full(slots, np.inf), np.full(slots, -np.inf)
            for b in batches:
                slot, v, _ = members(b)
                np.minimum.at(lo, slot, v)
                np.maximum.at(hi, slot, v)
            seen = np.nonzero(lo <= hi)[0]
            return {"slot": seen, "lo": lo[seen], "hi": hi[seen]}

        found = added(rows, ranges, {"lo": "min", "hi": "max"})
        slot = found["slot"].to_numpy()
        lo, hi = np.zeros(len(tree) * many), np.zeros(len(tree) * many)
        lo[slot], hi[slot] = found["lo"].to_numpy(), found["hi"].to_numpy()
        at = lo + (hi - lo) * draws[tree, node].ravel()
        usable = (drawn.ravel() >= 0) & (lo < hi) & (at < hi)

        def sides(batches, members=members, at=at, usable=usable):
            n = np.zeros(len(at) * 2 * k, np.int64)
            for b in batches:
                slot, v, line = members(b)
                code = b.column("code").to_numpy()[line]
                np.add.at(n, slot * (2 * k) + (v > at[slot]) * k + code, 1)
            n = n.reshape(-1, 2 * k)
            seen = np.nonzero(n.any(1) & usable)[0]
            return {"slot": seen, **{f"n{i}": n[seen, i] for i in range(2 * k)}}

        found = added(rows, sides, {f"n{i}": "SUM" for i in range(2 * k)})
        n = np.zeros((len(tree) * many, 2, k), np.int64)
        n[found["slot"].to_numpy()] = np.stack([found[f"n{i}"].to_numpy() for i in range(2 * k)], 1).reshape(-1, 2, k)
        w = n * weights
        gain = np.where(usable, purity(w[:, 0]) + purity(w[:, 1]) - purity(w.sum(1)), -1.0).reshape(-1, many)
        # the largest gain, then the largest feature, then the largest cut
        best = np.lexsort((at.reshape(-1, many), drawn, gain), axis=1)[:, -1]
        every = np.arange(len(tree))
        split = gain[every, best] > 1e-9
        t, m, p = tree[split], node[split], (every * many + best)[split]
        feature[t, m], cut[t, m], gains[t, m] = drawn.ravel()[p], at[p], gain.ravel()[p]
        counts[t, 2 * m], counts[t, 2 * m + 1] = n[p, 0], n[p, 1]
        if not split.any():
            break
    w = np.where(counts < 0, 0, counts) * weights
    return feature, cut, gains, np.where((counts[..., :1] >= 0) & (feature[..., None] < 0), w / np.maximum(w.sum(-1, keepdims=True), 1e-300), np.nan)


def mean_shares(width: int, feature: np.ndarray, cut: np.ndarray, shares: np.ndarray, depth: int):
    """Arrow function of the feature arrays: class shares of the leaves of a row, averaged over the trees."""
    def of(x: pa.Array) -> pa.Array:
        node = descend(matrix(x, width), feature, cut, depth)
        p = sum(shares[t, node[:, t]] for t in range(len(feature))) / len(feature)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * shares.shape[-1], pa.int32()), pa.array(p.ravel()))

    return F.arrow_udf(of, "array<double>")


def dealt(blocks: RDD, parts: int) -> RDD:
    """The blocks, evenly over ``parts`` partitions; what follows does not carry their derivation along."""
    return blocks.zipWithIndex().map(lambda b: (b[1], b[0])).partitionBy(parts, lambda i: i % parts).values()


# --- sums of a fixed length ---------------------------------------------------------------------------

def summed(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The array of ``size`` sums that ``of`` makes in each task, added up."""
    found = added(rows, lambda batches: {"slot": np.arange(size), "v": of(batches)}, {"v": "sum"})
    out = np.zeros(size)
    out[found["slot"].to_numpy()] = found["v"].to_numpy()
    return out


def all_threshold_sums(width: int, centre: np.ndarray, weights: np.ndarray, b: np.ndarray):
    """Task function: loss, slope and curvature of the all-threshold logistic at ``b`` (slopes, thresholds), added up in one array."""
    def of(batches):
        size, k = len(b), len(b) - width
        loss, slope, curve = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = matrix(batch.column("x"), width) - centre
            code = batch.column("code").to_numpy()
            sign = np.where(code[:, None] > np.arange(k), 1.0, -1.0)
            z = sign * ((x @ b[:width])[:, None] + b[width:])
            miss = np.exp(-np.logaddexp(0.0, z))  # the chance of the other side
            w = weights[code][:, None]
            loss += (w * np.logaddexp(0.0, -z)).sum()
            pull, bend = -w * sign * miss, w * miss * (1.0 - miss)
            slope += np.append(x.T @ pull.sum(1), pull.sum(0))
            curve[:width, :width] += x.T @ (bend.sum(1)[:, None] * x)
            curve[:width, width:] += x.T @ bend
            curve[width:, width:] += np.diag(bend.sum(0))
        curve[width:, :width] = curve[:width, width:].T
        return np.concatenate([[loss], slope, curve.ravel()])

    return of
