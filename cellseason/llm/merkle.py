"""A Merkle manifest of a dataset: one tree of leaves for each group, and one tree of the groups' roots.

Only every few levels of a tree are stored. A proof regenerates the levels in between from the stored nodes below them, one aligned
subtree at a time: it emits the siblings of each node and discards the subtree.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, shared_folder

#: Nodes of a run that become one; levels of a subtree: of these only the lowest is stored.
FAN, LEVELS = 3, 5
SUBTREE = FAN**LEVELS
_ABOVE = "path array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """SHA-256 of the values: "-" for null, else byte count, ":" and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(own: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, own, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of an aligned subtree, level by level, up to ``levels`` above the lowest."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return out


def levels_above(n: int, base: int) -> int:
    """How many levels a subtree that starts at level ``base`` of a tree of ``n`` leaves has: LEVELS, fewer at the root."""
    left, up = -(-n // FAN**base), 0
    while left > 1 and up < LEVELS:
        left, up = -(-left // FAN), up + 1
    return up


def _map(df: DataFrame, schema: str, run) -> DataFrame:
    """``run`` gives rows (as lists by column name) out of one row of ``df``; written out every few rows, so memory stays small."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def batches(source):
        for batch in source:
            for start in range(0, batch.num_rows, 16):
                out = {name: [] for name in arrow.names}
                for row in batch.slice(start, 16).to_pylist():
                    for name, values in run(row).items():
                        out[name] += values
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(batches, schema)


def _subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """One row an aligned subtree: tree, place (idx of its root LEVELS above), n, nodes in order; at most SUBTREE of them."""
    return (nodes.groupBy("tree", "n", F.floor(F.col("idx") / SUBTREE).cast("long").alias("place"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "hash", *more))).alias("nodes")))


@dataclass
class Forest:
    """Stored levels 0, LEVELS, 2 * LEVELS, ... of many trees, as tables (tree, n, idx, hash), the lowest also with other columns; ``roots``: tree, n, hash."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, folder: str) -> Forest:
    """Trees out of leaves (tree, idx, n, hash, other columns): every few levels are written to ``folder``."""
    spark = leaves.sparkSession
    leaves.write.parquet(f"{folder}/level=0")
    levels = [spark.read.schema(leaves.schema).parquet(f"{folder}/level=0")]
    largest, base = levels[0].agg(F.max("n")).first()[0] or 0, 0
    roots = levels[0].filter("n = 1").select("tree", "n", "hash")
    while FAN**base < largest:
        def top(row, base=base):
            up = levels_above(row["n"], base)
            return {"tree": [row["tree"]], "n": [row["n"]], "idx": [row["place"]], "hash": subtree([x["hash"] for x in row["nodes"]], up)[-1]}

        schema = "tree string, n long, idx long, hash string"
        open_trees = levels[-1].filter(F.col("n") > FAN**base).select("tree", "n", "idx", "hash")
        base += LEVELS
        _map(_subtrees(open_trees), schema, top).write.parquet(f"{folder}/level={base}")
        levels.append(spark.read.schema(schema).parquet(f"{folder}/level={base}"))
        ended = (F.col("n") > FAN ** (base - LEVELS)) & (F.col("n") <= FAN**base)
        roots = roots.unionByName(levels[-1].filter(ended).select("tree", "n", "hash"))
    return Forest(levels, roots)


def paths(forest: Forest, above: DataFrame, *more: str) -> DataFrame:
    """The leaves of all trees, with ``more`` of their columns, the columns of ``above``, and the path from each leaf to the end of ``above``.

    ``above``: one row a tree (tree, n, path, other columns): what follows the tree's root. From the top down, each subtree takes the path of
    its root and gives one to each of its lowest nodes.
    """
    extra = [c for c in above.columns if c not in ("tree", "n", "path")]
    found = None
    for number in reversed(range(len(forest.levels))):
        base, nodes = number * LEVELS, forest.levels[number]
        low = FAN**base if base else 0
        nodes = nodes.filter(F.col("n") > low)  # trees that end below are rooted at their stored root
        ends = above.filter((F.col("n") > low) & (F.col("n") <= FAN ** (base + LEVELS))).select("tree", F.lit(0).cast("long").alias("place"), "path", *extra)
        tops = ends if found is None else ends.unionByName(found.select("tree", F.col("idx").alias("place"), "path", *extra))
        own = [c for c in more if number == 0]
        kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *above.schema]}
        schema = ", ".join(["tree string, idx long, hash string", *[f"`{c}` {kinds[c]}" for c in [*own, *extra]], _ABOVE])

        def down(row, base=base, own=own):
            lowest = row["nodes"]
            inner = subtree([x["hash"] for x in lowest], levels_above(row["n"], base))
            steps = []  # of each level: the step of each node
            for level in inner[:-1]:
                steps.append([{"left": "".join(level[j - j % FAN : j]), "right": "".join(level[j + 1 : j - j % FAN + FAN])} for j in range(len(level))])
            way = [[own_steps[i // FAN**k] for k, own_steps in enumerate(steps)] + row["path"] for i in range(len(lowest))]
            size = len(lowest)
            return {"tree": [row["tree"]] * size, "idx": [x["idx"] for x in lowest], "hash": [x["hash"] for x in lowest], "path": way,
                    **{c: [x[c] for x in lowest] for c in own}, **{c: [row[c]] * size for c in extra}}

        found = _map(_subtrees(nodes, *own).join(tops, ["tree", "place"]), schema, down)
    return found


def prove(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), order_col: str = "doc_id", tree_col: str = "source",
          folder: str | None = None, **more: Column) -> DataFrame:
    """One row a row of ``docs``: ``order_col``, the columns of ``more`` (computed from ``docs``), leaf, subroot, root, path.

    ``path`` is the proof: of each level from the leaf to the root the siblings to the left and to the right. The manifest stays in ``folder``
    (by default a new one in the shared folder): ``trees`` and ``roots``, each with its stored levels.

    Leaves are the rows' ``fields`` and ascend by ``order_col``, nulls first, equal ones by their hash; rows alike in all fields are
    leaves of their own. Groups ascend by the bytes of ``tree_col``, a null group comes first and is a tree of its own. A group of one row is
    its own root, and so is a lone group. Null, empty and long values are hashed as they are. No rows give no rows. Other columns are ignored,
    names do not clash. Leaves are placed by ranges, so a group may hold most rows; a task holds a few subtrees of SUBTREE nodes at most.
    """
    folder = folder or shared_folder(docs.sparkSession, "merkle")
    tree = F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0"))
    rows = docs.select(F.col(order_col).alias("order_key"), tree.alias("tree"), leaf(*[F.col(c) for c in fields]).alias("hash"), F.struct(F.lit(0).alias("_"), *[v.alias(c) for c, v in more.items()]).alias("more"))
    rows.write.parquet(f"{folder}/rows")
    rows = docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    trees = grow(placed(rows, "tree", F.col("order_key"), F.col("hash")), f"{folder}/trees")
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("own_tree"), F.col("n").alias("own_n"), "hash")
    roots = grow(placed(subroots, "tree", F.col("own_tree")), f"{folder}/roots")
    end = roots.roots.select("tree", "n", F.col("hash").alias("root"), F.lit([]).cast("array<struct<left:string,right:string>>").alias("path"))
    above = paths(roots, end, "own_tree", "own_n").select(F.col("own_tree").alias("tree"), F.col("own_n").alias("n"), F.col("hash").alias("subroot"), "root", "path")
    return paths(trees, above, "order_key", "more").select(F.col("order_key").alias(order_col), *[F.col(f"more.{c}").alias(c) for c in more], F.col("hash").alias("leaf"), "subroot", "root", "path")
