"""Boosted regression trees over binned rows, by the rules of Spark ML's ``GBTClassifier``: tasks add up, the driver keeps the cuts.

Features with few bins share one joint index, so that one count gives the sums of several features; of two sister nodes only the one with the
smaller weight is counted, the other is what remains of their parent. Up to ``SMALL`` rows a model is grown by one task, beyond that every
level is one pass over blocks of rows that hold their margins; the trees of all classes grow together there.

Trees have heap numbers (root 1, children 2n and 2n + 1); ``feature`` is -1 where a node has no cut, and a bin above ``cut`` goes right."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import dealt, matrix
from .binned import binned, walk

# the functions travel to the executors, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

JOINT = 1024  # bins of a joint index
CHUNK = 1 << 16
SMALL = 1 << 20  # tables of at most as many rows are boosted by one task a class
KEPT = 16  # rounds after which the lineage of the margins is cut


class Layout:
    """Joint indices: which features they hold, and where the sums of a feature lie in theirs."""

    def __init__(self, cuts: list[np.ndarray], most: int = JOINT):
        bins = [len(c) + 1 for c in cuts]
        groups, size = [], most + 1
        for f in sorted(range(len(cuts)), key=lambda f: bins[f]):
            if size * bins[f] > most:
                groups.append([])
                size = 1
            groups[-1].append(f)
            size *= bins[f]
        self.cuts, self.groups, self.bins = cuts, groups, max(bins, default=1)
        self.shapes = [tuple(bins[f] for f in g) for g in groups]
        self.sizes = [int(np.prod(s)) for s in self.shapes]
        self.at = {f: (g, i) for g, of in enumerate(groups) for i, f in enumerate(of)}

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Joint indices of the rows (columns)."""
        b, out = binned(x, self.cuts), np.empty((len(self.groups), len(x)), np.uint16)
        for g, of in enumerate(self.groups):
            out[g] = np.ravel_multi_index([b[:, f].astype(np.int64) for f in of], self.shapes[g])
        return out

    def right(self, f: int, cut: int) -> tuple[int, np.ndarray]:
        """Joint index that a cut looks at, and which of its values go right."""
        g, i = self.at[f]
        return g, np.unravel_index(np.arange(self.sizes[g]), self.shapes[g])[i] > cut

    def counted(self, joint: np.ndarray, lines: list, sums: list[np.ndarray]) -> list[np.ndarray]:
        """For each joint index the sums of the rows ``lines`` (one list a node, or None: all rows are one node) by node and bin, one after the other."""
        out, nodes = [], len(lines)
        if lines[0] is not None:
            of = np.repeat(np.arange(nodes), [len(i) for i in lines])
            lines = np.concatenate(lines)
        for g, size in enumerate(self.sizes):
            at = joint[g] if lines is None or isinstance(lines, list) else joint[g].take(lines) + of * size
            out += [np.bincount(at, s, nodes * size).reshape(nodes, size) for s in sums]
        return out

    def by_feature(self, counted: list[np.ndarray], many: int) -> np.ndarray:
        """Sums by node, kind of sum, feature and bin."""
        nodes = len(counted[0])
        out = np.zeros((nodes, many, len(self.cuts), self.bins))
        for g, of in enumerate(self.groups):
            for j in range(many):
                cell = counted[g * many + j].reshape(nodes, *self.shapes[g])
                for i, f in enumerate(of):
                    out[:, j, f, :self.shapes[g][i]] = cell.sum(tuple(a for a in range(1, cell.ndim) if a != i + 1))
        return out


class Tree:
    """A tree that grows level by level out of the sums of its nodes; sums are (weight, weight x residual) by feature and bin."""

    def __init__(self, depth: int, least: float):
        self.depth, self.least = depth, least  # half the smallest weight of a row: less is no row
        self.feature, self.cut = np.full(2 << depth, -1, np.int64), np.zeros(2 << depth, np.int64)
        self.value = np.zeros(2 << depth)
        self.sums, self.pairs = {}, [(1, None)]  # open pairs of sisters: the one that is counted, the other

    def __getstate__(self):
        return self.__dict__ | {"sums": {}}  # tasks do not need them

    def wanted(self) -> list[int]:
        return [counted for counted, _ in self.pairs]

    def take(self, sums: np.ndarray) -> None:
        """Sums of the wanted nodes: cuts them and their sisters, opens what lies below."""
        nodes, rows = [], []
        for (counted, other), own in zip(self.pairs, sums):
            nodes.append(counted)
            rows.append(own)
            if other is not None:
                nodes.append(other)
                rows.append(self.sums[counted // 2] - own)
        found = np.stack(rows)
        left = found.cumsum(-1)
        whole = left[:, :, :1, -1:]
        self.value[nodes] = (whole[:, 1] / np.maximum(whole[:, 0], 1e-300)).ravel()
        w, s = left[:, 0], left[:, 1]
        rest, t = whole[:, 0] - w, whole[:, 1] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((w > self.least) & (rest > self.least), s * s / w + t * t / rest, -np.inf).reshape(len(nodes), -1)
        best, every = gain.argmax(1), np.arange(len(nodes))
        top = whole[:, 0, 0, 0]
        cuts = (gain[every, best] - whole[:, 1, 0, 0] ** 2 / np.maximum(top, 1e-300) > 1e-12 * top) & (2 * np.array(nodes) < len(self.feature))
        bins = found.shape[-1]
        self.sums, self.pairs = {}, []
        for i in np.nonzero(cuts)[0]:
            m, f, b = nodes[i], best[i] // bins, best[i] % bins
            self.feature[m], self.cut[m] = f, b
            lw, ls = left[i, 0, f, b], left[i, 1, f, b]
            self.value[2 * m], self.value[2 * m + 1] = ls / lw, (whole[i, 1, 0, 0] - ls) / (top[i] - lw)
            if 4 * m < len(self.feature):  # the children are not at the last level
                few = 2 * m if lw <= top[i] - lw else 2 * m + 1
                self.sums[m] = found[i]
                self.pairs.append((few, few ^ 1))

    def rows_below(self, layout: Layout, joint: np.ndarray, lines: dict) -> dict:
        """Rows of the nodes at the next level, from those (by node; None: all) at one."""
        out = {}
        for m, rows in lines.items():
            if self.feature[m] >= 0:
                g, right = layout.right(int(self.feature[m]), int(self.cut[m]))
                side = right[joint[g] if rows is None else joint[g].take(rows)]
                every = np.arange(len(side), dtype=np.int32) if rows is None else rows
                out[2 * m], out[2 * m + 1] = every[~side], every[side]
        return out

    def end(self, margin: np.ndarray, lines: dict, step: float) -> None:
        """Adds the values of the leaves among the nodes ``lines`` to the margins of their rows."""
        for m, rows in lines.items():
            if self.feature[m] < 0:
                margin[slice(None) if rows is None else rows] += step * self.value[m]


def pull(sign: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted on: the labels (1 and -1) at first, then the negative slopes of the logistic loss."""
    return sign if margin is None else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def grown_alone(layout: Layout, joint: np.ndarray, code: np.ndarray, weights: np.ndarray, target: int, rounds: int, depth: int, step: float) -> list[Tree]:
    """The trees of one class, by one task."""
    w, sign = weights[code], np.where(code == target, 1.0, -1.0)
    margin, trees, least = np.zeros(len(code)), [], weights.min() / 2
    root = layout.counted(joint, [None], [w])
    for number in range(rounds):
        r = w * pull(sign, margin if number else None)
        tree, lines = Tree(depth, least), {1: None}
        while lines:
            if 1 in lines:
                pulls = layout.counted(joint, [None], [r])
                tree.take(layout.by_feature([c for pair in zip(root, pulls) for c in pair], 2))
            elif tree.pairs:
                of = [lines[m] for m in tree.wanted()]
                every = np.concatenate(of)
                tree.take(layout.by_feature(layout.counted(joint, of, [w[every], r[every]]), 2))
            tree.end(margin, lines, step if number else 1.0)
            lines = tree.rows_below(layout, joint, lines)
        trees.append(tree)
    return trees


def grown_by_passes(blocks: RDD, layout: Layout, weights: np.ndarray, targets: list[int], rounds: int, depth: int, step: float) -> list[list[Tree]]:
    """The trees of all classes, level by level: a pass over the blocks for each level, and their margins renewed with each round."""
    least = weights.min() / 2
    state, held, forests = blocks.map(lambda b: (*b, None)), [], [[] for _ in targets]
    for number in range(rounds):
        if number:
            last, by = [f[-1] for f in forests], step if number > 1 else 1.0

            def renewed(block, last=last, by=by):
                joint, code, margin = block
                margin = np.zeros((len(last), len(code))) if margin is None else margin.copy()
                for m, tree in zip(margin, last):
                    lines = {1: None}
                    while lines:
                        tree.end(m, lines, by)
                        lines = tree.rows_below(layout, joint, lines)
                return joint, code, margin

            state = state.map(renewed).persist(StorageLevel.MEMORY_AND_DISK)
            if number % KEPT == 0:
                state.localCheckpoint()
            held.append(state)
        trees = [Tree(depth, least) for _ in targets]
        level = 0
        while any(t.pairs for t in trees):
            def tally(part, trees=trees, level=level):
                total = None
                for joint, code, margin in part:
                    w, got = weights[code], []
                    for i, (target, tree) in enumerate(zip(targets, trees)):
                        if not tree.pairs:
                            continue
                        sign, own = np.where(code == target, 1.0, -1.0), None if margin is None else margin[i]
                        lines = {1: None}
                        for _ in range(level):
                            lines = tree.rows_below(layout, joint, lines)
                        of = [lines[m] for m in tree.wanted()]
                        every = slice(None) if level == 0 else np.concatenate(of)
                        got += layout.counted(joint, of, [w[every], w[every] * pull(sign[every], None if own is None else own[every])])
                    total = got if total is None else [a + b for a, b in zip(total, got)]
                if total is not None:
                    each = 2 * len(layout.groups)
                    yield [layout.by_feature(total[i:i + each], 2) for i in range(0, len(total), each)]

            parts = state.mapPartitions(tally)
            add = lambda a, b: [x + y for x, y in zip(a, b)]
            found = parts.treeReduce(add) if parts.getNumPartitions() > 64 else _added(parts.collect())
            for tree, sums in zip([t for t in trees if t.pairs], found):
                tree.take(sums)
            level += 1
        for f, t in zip(forests, trees):
            t.sums = {}
            f.append(t)
        while len(held) > 1:
            held.pop(0).unpersist()
    for s in held:
        s.unpersist()
    return forests


def _added(parts: list) -> list[np.ndarray]:
    return [sum(p[i] for p in parts) for i in range(len(parts[0]))]


def blocks(rows: DataFrame, layout: Layout, width: int, parts: int | None = None) -> RDD:
    """Joint indices and codes of ``rows`` (``x`` array, ``code``) in blocks of about ``CHUNK`` rows, dealt evenly over ``parts`` partitions if given."""
    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        def joined():
            joint, code = np.concatenate([h[0] for h in held], 1), np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([joint.tobytes()], pa.binary()), pa.array([code.tobytes()], pa.binary())], names=["joint", "code"])
        for b in batches:
            held.append((layout.joint(matrix(b.column("x"), width)), b.column("code").to_numpy().astype(np.uint8)))
            n += b.num_rows
            if n >= CHUNK:
                yield joined()
                held, n = [], 0
        if held:
            yield joined()

    def back(row):
        code = np.frombuffer(bytes(row["code"]), np.uint8)
        return np.frombuffer(bytes(row["joint"]), np.uint16).reshape(-1, len(code)), code

    made = rows.select("x", "code").mapInArrow(run, "joint binary, code binary").rdd.map(back)
    return dealt(made, parts) if parts else made


def boost(rows: DataFrame, n: int, cuts: list[np.ndarray], weights: np.ndarray, targets: list[int], rounds: int, depth: int, step: float, small: int = SMALL):
    """Trees of one boosted binary model for each of ``targets`` (codes that are the positive class): ``(feature, cut, value)`` by target, round
    and heap number; the values hold the step."""
    layout = Layout(cuts)
    if n <= small:
        def grow(part):
            part = list(part)
            if part:
                target = part[0][0]
                joint, code = np.concatenate([b[0] for _, b in part], 1), np.concatenate([b[1] for _, b in part])
                trees = grown_alone(layout, joint, code, weights, target, rounds, depth, step)
                yield target, [np.stack([getattr(t, a) for t in trees]) for a in ("feature", "cut", "value")]

        place = {t: i for i, t in enumerate(targets)}
        dealt = blocks(rows, layout, len(cuts)).flatMap(lambda b: [(t, b) for t in targets]).partitionBy(len(targets), lambda t: place[t])
        of = dict(dealt.mapPartitions(grow).collect())
        found = [of[t] for t in targets]
    else:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        kept = blocks(rows, layout, len(cuts), cores).persist(StorageLevel.MEMORY_AND_DISK)
        forests = grown_by_passes(kept, layout, weights, targets, rounds, depth, step)
        kept.unpersist()
        found = [[np.stack([getattr(t, a) for t in f]) for a in ("feature", "cut", "value")] for f in forests]
    feature, cut, value = (np.stack([f[i] for f in found]) for i in range(3))
    value[:, 1:] *= step
    return feature, cut.astype(np.uint8), value


def margins(cuts: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int):
    """Arrow function of the feature arrays: margin of each target."""
    def of(x):
        import pyarrow as pa

        b = binned(matrix(x, len(cuts)), cuts)
        m = np.zeros((len(x), len(feature)))
        for i in range(len(feature)):
            for f, c, v in zip(feature[i], cut[i], value[i]):
                m[:, i] += v[walk(b, f, c, depth)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))

    return F.arrow_udf(of, "array<double>")
