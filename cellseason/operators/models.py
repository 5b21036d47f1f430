"""Ordinal, binary and two-stage models as Spark ML jobs.

A model is an object with ``fit(train) -> self`` and ``predict(df)``; predictions add ``y_pred`` (severity)
and ``score`` (presence). Training rows carry ``features`` (vector) and ``y`` (severity); class weights are those of
the rows a model is fitted on. Drivers only ever see per-class counts, class lists and season lists.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Lock
from typing import Callable

import numpy as np
from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PHASES, SEVERITY_LEVELS
from ..functions.scoring import (category_code, draw, presence_from_probabilities, presence_from_score, thresholded_phase,
                                 to_ordinal)
from ..session import scratch_dir
from . import batches, binned, boosting, linear, net
from .metrics import best_f1_threshold, best_target_threshold, binary_report_with_global, ordinal_report, phase_report, regression_errors, with_global
from .order import exact_median, stored, with_median_fill
from .training import (fold_list, fold_rows, positive_weight, stratified_holdout, walk_forward_folds, with_class_weight)

SEED = 42


def assemble(df: DataFrame, features: list[str], label: str | None = "severite") -> DataFrame:
    """Adds the feature vector (NULLs must be filled before) and, for training, ``y``."""
    numeric = df.withColumns({f: F.col(f).cast("double") for f in features})
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(numeric)
    if label is None:
        return out
    return out.withColumn("y", F.col(label).cast("int"))


def _level_counts(train: DataFrame) -> dict[int, int]:
    """Rows of each level of the training rows; more levels than the scale has are an error, never cut."""
    rows = train.groupBy("y").agg(F.count("*").alias("n")).limit(len(SEVERITY_LEVELS) + 1).collect()
    if len(rows) > len(SEVERITY_LEVELS):
        raise ValueError(f"more than {len(SEVERITY_LEVELS)} levels in the training rows")
    return {r["y"]: r["n"] for r in sorted(rows, key=lambda r: r["y"])}


def _classes(train: DataFrame) -> list[int]:
    return list(_level_counts(train))


def _with_code(df: DataFrame, classes: list[int]) -> DataFrame:
    """Levels re-encoded as contiguous codes."""
    return df.withColumn("__code", category_code("y", classes).cast("double"))


def _decode(code: Column, classes: list[int]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), code.cast("int"))


# --- regressions --------------------------------------------------------------------------------------

def vector_width(df: DataFrame, features: str = "features") -> int:
    """Length of the feature vectors: from the column's metadata, else from a row (0 without rows)."""
    known = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known is None:
        row = df.select(F.size(vector_to_array(features)).alias("n")).first()
        known = row["n"] if row else 0
    return int(known)


class Ridge:
    """Weighted ridge with penalty ``alpha``, rounded to a level. One aggregation gives the sums of products of each level;
    class weights follow from their counts, so nothing is scanned twice."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, train: DataFrame) -> "Ridge":
        width = vector_width(train)
        sums = linear.matrices(linear.moments(train, vector_to_array("features"), width, F.col("y"), ["y"]), ["y"], width, len(SEVERITY_LEVELS))
        if not sums:
            raise ValueError("no levels in the training rows")
        self.model = linear.ridge_of_levels({level: m for (level,), m in sums.items()}, self.alpha)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return _frame_regression(df.withColumn("__raw", self.model.of(vector_to_array("features"))))


def walk_forward_ridge(df: DataFrame, alpha: float = 1.0, campaign: str = "campagne_calc") -> tuple[DataFrame, dict[str, linear.Fit]]:
    """The ridge of every walk-forward fold: predictions of all test seasons, and the fits by test season.

    The rows are scanned once for the sums of all seasons and once for all predictions; ``Ridge`` fitted fold by fold gives the same."""
    width, folds = vector_width(df), fold_list(walk_forward_folds(df, campaign))
    sums = linear.by_season(linear.moments(df, vector_to_array("features"), width, F.col("y"), [campaign, "y"]), campaign, "y", width)
    fits = {test: linear.ridge_of_levels(levels, alpha) for test, levels in linear.expanding(sums, folds)}
    table = df.sparkSession.createDataFrame([(c, f.intercept, f.coefficients.tolist()) for c, f in fits.items()], f"`{campaign}` string, __a double, __b array<double>")
    dot = F.aggregate(F.zip_with(vector_to_array("features"), "__b", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return _frame_regression(df.join(table, campaign).withColumn("__raw", F.col("__a") + dot)).drop("__a", "__b"), fits


def _frame_regression(df: DataFrame) -> DataFrame:
    return df.withColumns({"y_pred": to_ordinal("__raw"), "score": presence_from_score("__raw")}).drop("__raw")


class AllThresholdLogistic:
    """Ordinal logistic with shared slopes and one threshold per level border.

    Each row counts once per border (is the level above it?); the thresholds carry next to no penalty (``BIG``). Newton steps,
    halved where the loss would rise, each from one scan that adds up loss, slope and curvature. The level is the number of
    borders passed."""

    BIG = 100.0

    def __init__(self, alpha: float = 1.0, max_iter: int = 100):
        self.alpha, self.max_iter = alpha, max_iter

    def fit(self, train: DataFrame) -> "AllThresholdLogistic":
        own = _level_counts(train)
        self.classes = list(own)
        if len(self.classes) < 2:
            raise ValueError("an ordinal model needs at least two levels")
        weights = np.array([sum(own.values()) / (len(own) * n) for n in own.values()])
        rows = stored(_with_code(train, self.classes).select(vector_to_array("features").alias("x"), F.col("__code").cast("int").alias("code")))
        # centring only moves the thresholds, and keeps the fit well conditioned
        centre = np.array(train.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"])
        width, k = len(centre), len(own) - 1
        penalty = np.append(np.full(width, self.alpha), np.full(k, self.alpha / self.BIG ** 2))

        def at(b: np.ndarray):
            """Penalised loss with its slope and curvature."""
            size = width + k
            found = batches.summed(rows, batches.all_threshold_sums(width, centre, weights, b), 1 + size + size * size)
            slope, curve = found[1:1 + size] + penalty * b, found[1 + size:].reshape(size, size) + np.diag(penalty)
            return found[0] + 0.5 * (penalty * b * b).sum(), slope, curve

        b = np.zeros(width + k)
        loss, slope, curve = at(b)
        step = np.linalg.solve(curve, slope)
        for _ in range(self.max_iter):
            if slope @ step <= 1e-12 * loss:  # twice the fall that a full step promises
                break
            new = at(b - step)
            if new[0] > loss:
                step = step / 2
                continue
            b, (loss, slope, curve) = b - step, new
            step = np.linalg.solve(curve, slope)
        self.slopes = b[:width].tolist()
        # passing border j means slope.x + threshold_j > 0; sorting keeps the borders ordered
        self.thresholds = sorted((b[width:] - b[:width] @ centre).tolist(), reverse=True)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(s)) for s in self.slopes]), lambda a, b: a * b),
                          F.lit(0.0), lambda a, v: a + v)
        out = df.withColumn("__dot", dot)
        passed = sum((F.when(F.col("__dot") + F.lit(float(t)) > 0, 1).otherwise(0) for t in self.thresholds), F.lit(0))
        return _frame_regression(out.withColumn("__raw", _decode(passed, self.classes).cast("double"))).drop("__dot")


def in_threads(spark, jobs: list[Callable[[], object]], at_once: int = 4) -> list:
    """Results of independent jobs, a few at a time; each thread has its own pool of the fair scheduler, where that is on."""
    def run(job, number):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % at_once}")
        return job()

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), job, i) for i, job in enumerate(jobs)]]


# --- classifiers ----------------------------------------------------------------------------------------

class Classifier:
    """Any Spark ML classifier over contiguous codes; ``one_vs_rest`` wraps binary ones."""

    def __init__(self, make: Callable[[int, int], object], weighted: bool = True, one_vs_rest: bool = False):
        self.make, self.weighted, self.one_vs_rest = make, weighted, one_vs_rest

    def fit(self, train: DataFrame) -> "Classifier":
        self.classes = _classes(train)
        coded = _with_code(train, self.classes)
        width = int(coded.select(F.size(vector_to_array("features")).alias("n")).first()["n"])
        if len(self.classes) == 1:
            self.model = None
            return self
        est = self.make(width, len(self.classes)).setLabelCol("__code").setFeaturesCol("features")
        if self.one_vs_rest and len(self.classes) > 2:
            est = OneVsRest(classifier=est, labelCol="__code", featuresCol="features", parallelism=4)
        if self.weighted:
            coded, est = with_class_weight(coded, "y"), est.setWeightCol("class_weight")
        self.model = est.fit(coded)
        return self

    def _probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``__p`` (array over the classes) and ``__code``."""
        if self.model is None:
            return df.withColumns({"__p": F.array(F.lit(1.0)), "__code": F.lit(0.0)})
        out = self.model.transform(df)
        if "probability" in out.columns:
            p = vector_to_array("probability")
        else:  # one-vs-rest margins: logistic per class, normalised
            each = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
            p = F.transform(each, lambda v: v / F.aggregate(each, F.lit(0.0), lambda a, b: a + b))
        out = out.withColumns({"__p": p, "__code": F.col("prediction")})
        return out.drop("probability", "rawPrediction", "prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        return self._probabilities(df).withColumns({
            "y_pred": _decode(F.col("__code"), self.classes),
            "score": presence_from_probabilities("__p", self.classes)}).drop("__p", "__code")


class StoppedOneVsRest(Classifier):
    """One boosted binary classifier for each class; each stops by itself on a hold-out that is stratified by class.

    Spark's own one-vs-rest drops the column that marks the hold-out. Here every binary fit gets it: boosting ends when the weighted
    loss on the held-out rows no longer improves by ``tolerance`` of itself, and the rounds up to the best one are kept (``rounds_kept`` by
    class). Class weights are those of the rows that train; held-out rows weigh 1. A class without held-out rows, or a hold-out that is
    empty, just has less to stop on. One class alone needs no fit."""

    def __init__(self, rounds: int = 300, depth: int = 5, step: float = 0.05, key: str = "row_id", share: float = 0.20, tolerance: float = 0.01):
        self.rounds, self.depth, self.step, self.key, self.share, self.tolerance = rounds, depth, step, key, share, tolerance

    def fit(self, train: DataFrame) -> "StoppedOneVsRest":
        self.classes = _classes(train)
        self.models = []
        if len(self.classes) > 1:
            rows = stratified_holdout(_with_code(train, self.classes), self.key, "y", self.share)
            own = _level_counts(rows.filter("not is_holdout"))
            weight = F.create_map(*[x for c, n in own.items() for x in (F.lit(c), F.lit(sum(own.values()) / (len(own) * n)))])
            rows = stored(rows.withColumn("__w", F.when(F.col("is_holdout"), F.lit(1.0)).otherwise(F.try_element_at(weight, F.col("y")))).select("features", "__code", "__w", "is_holdout"))
            held = not rows.filter("is_holdout").isEmpty()

            def one(code: int):
                est = GBTClassifier(labelCol="__is", weightCol="__w", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, seed=SEED)
                if held:
                    est = est.setValidationIndicatorCol("is_holdout").setParams(validationTol=self.tolerance)
                own_rows = rows.withColumn("__is", (F.col("__code") == code).cast("double"))
                return est.fit(own_rows if held else own_rows.drop("is_holdout"))

            self.models = in_threads(train.sparkSession, [lambda c=c: one(c) for c in range(len(self.classes))])
        self.rounds_kept = {c: m.getNumTrees for c, m in zip(self.classes, self.models)}
        return self

    def _probabilities(self, df: DataFrame) -> DataFrame:
        if not self.models:
            return df.withColumns({"__p": F.array(F.lit(1.0)), "__code": F.lit(0.0)})
        out, margins = df, []
        for i, m in enumerate(self.models):
            m = m.copy().setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__q{i}").setPredictionCol(f"__y{i}")
            out = m.transform(out).drop(f"__q{i}", f"__y{i}")
            margins.append(F.get(vector_to_array(f"__r{i}"), F.lit(1)))
        each = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)) for m in margins]
        out = out.withColumn("__e", F.array(*each)).drop(*[f"__r{i}" for i in range(len(margins))])
        total = F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("__p", F.transform("__e", lambda v: v / total))
        return out.withColumn("__code", (F.array_position("__p", F.array_max("__p")) - 1).cast("double")).drop("__e")


class ExtraTrees(Classifier):
    """Extremely randomised trees: every node draws about the square root of the features (one of each equal stretch of their list, from a
    random start on) and for each of them one cut between the least and the largest value of the node's rows; the cut with the largest fall of the weighted Gini impurity is taken.

    All trees grow together, level by level: one scan gives the ranges, a second one the class sums on both sides of the cuts (``batches.grow_random``).
    Draws come from seed, tree, node and feature, so a refit gives the same trees. A node ends at ``depth``, when it is
    pure, or when its drawn features are constant. ``splits`` and ``leaves`` are tables with heap numbers (root 1, children 2n and 2n + 1).
    ``at_once`` trees share their scans; the driver holds their cuts, at most ``2**depth`` a tree."""

    def __init__(self, trees: int = 300, depth: int = 12, seed: int = SEED, weighted: bool = True, at_once: int = 32):
        self.trees, self.depth, self.seed, self.weighted, self.at_once = trees, depth, seed, weighted, at_once

    def _draw(self, *parts) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), *parts), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def _draws(self, spark, first: int, end: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Features that each node of some trees draws (-1 where a place is empty), and where in its range each of them is cut."""
        many, size = max(1, math.isqrt(width)), 1 << self.depth
        start = F.floor(self._draw("tree", "node", F.lit("start")) * width)
        features = F.array_distinct(F.array(*[F.pmod(start + F.floor((self._draw("tree", "node", F.lit(j)) + j) * width / many), F.lit(width)).cast("int") for j in range(many)]))
        nodes = spark.range(first * size, end * size).select(F.floor(F.col("id") / size).cast("int").alias("tree"), (F.col("id") % size).alias("node")).withColumn("fs", features)
        f = [F.coalesce(F.get("fs", F.lit(j)), F.lit(-1)).alias(f"f{j}") for j in range(many)]
        cut = [self._draw("tree", "node", F.get("fs", F.lit(j)), F.lit("cut")).alias(f"c{j}") for j in range(many)]
        got = nodes.select("tree", "node", *f, *cut).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        of = lambda name: np.stack([got[f"{name}{j}"].to_numpy() for j in range(many)], 1).reshape(end - first, size, many)
        return of("f").astype(np.int64), of("c")

    def fit(self, train: DataFrame) -> "ExtraTrees":
        own = _level_counts(train)
        self.classes, self.model = list(own), None
        if len(self.classes) == 1:
            return self
        self.width, root = vector_width(train), np.array(list(own.values()))
        weights = root.sum() / (len(root) * root) if self.weighted else np.ones(len(root))
        rows = stored(_with_code(train, self.classes).select(vector_to_array("features").alias("x"), F.col("__code").cast("int").alias("code")))
        grown = []
        for first in range(0, self.trees, self.at_once):
            draws = self._draws(train.sparkSession, first, min(first + self.at_once, self.trees), self.width)
            grown.append(batches.grow_random(rows, self.width, weights, root, *draws, self.depth))
        self.model = tuple(np.concatenate(parts) for parts in zip(*grown))
        self.spark = train.sparkSession
        return self

    @property
    def splits(self) -> DataFrame:
        feature, cut, gain, _ = self.model
        tree, node = np.nonzero(feature >= 0)
        return self.spark.createDataFrame(list(zip(tree.tolist(), node.tolist(), feature[tree, node].tolist(), cut[tree, node].tolist(), gain[tree, node].tolist())),
                                          "tree int, node bigint, f int, cut double, gain double")

    @property
    def leaves(self) -> DataFrame:
        shares = self.model[3]
        tree, node = np.nonzero(~np.isnan(shares[..., 0]))
        return self.spark.createDataFrame(list(zip(tree.tolist(), node.tolist(), shares[tree, node].tolist())), "tree int, node bigint, shares array<double>")

    def _probabilities(self, df: DataFrame) -> DataFrame:
        """Mean class shares of the leaves that a row falls into."""
        if self.model is None:
            return super()._probabilities(df)
        feature, cut, _, shares = self.model
        voted = df.withColumn("__p", batches.mean_shares(self.width, feature, cut, shares, self.depth)(vector_to_array("features")))
        return voted.withColumn("__code", F.array_position("__p", F.array_max("__p")).cast("int") - 1)


def _binnable(train: DataFrame, classes: list[int], key: str) -> DataFrame:
    """What ``binned`` takes: bags and samples are drawn by the row key, where there is one, and the content of the row."""
    own = [key] if key in train.columns else []
    coded = _with_code(train, classes).withColumn("x", vector_to_array("features"))
    return coded.select("x", F.col("__code").cast("int").alias("code"), F.xxhash64(*own, "x", "y").alias("key"))


class Forest(Classifier):
    """Random forest by Spark ML's rules (Poisson bags, the square root of the features at a node, 32 bins, weighted Gini impurity; cuts whose
    two sides vote alike are taken back), grown by ``binned.grow_forest``; one tree alone may cut by all features.

    Draws come from seed, tree, node and row, so a refit gives the same trees on any number of cores. Trees that are grown together send at most
    about ``PAIRS`` rows to the tasks that finish nodes; the driver holds the cuts, at most ``2**depth`` a tree."""

    PAIRS = 1 << 28

    def __init__(self, trees: int = 300, depth: int = 12, seed: int = SEED, weighted: bool = True, key: str = "row_id", bootstrap: bool = True, small: int = binned.SMALL):
        self.trees, self.depth, self.seed, self.weighted, self.key, self.bootstrap, self.small = trees, depth, seed, weighted, key, bootstrap, small

    def fit(self, train: DataFrame) -> "Forest":
        own = _level_counts(train)
        self.classes, self.model, n = list(own), None, sum(own.values())
        if len(own) == 1:
            return self
        width, root = vector_width(train), np.array(list(own.values()))
        weights = n / (len(root) * root) if self.weighted else np.ones(len(root))
        rows = _binnable(train, self.classes, self.key)
        cuts = binned.cut_points(rows, width, n)
        table, many = binned.blocks(rows, width, cuts), width if self.trees == 1 else math.isqrt(width - 1) + 1
        at_once = max(8, self.PAIRS // n)
        grown = [binned.grow_forest(table, width, weights, n, first, min(first + at_once, self.trees), self.depth, many, self.seed, self.bootstrap, self.small)
                 for first in range(0, self.trees, at_once)]
        feature, cut, counts = (np.concatenate(parts) for parts in zip(*grown))
        votes = counts * weights
        shares = (votes / np.maximum(votes.sum(-1, keepdims=True), 1e-300)).astype(np.float32)
        self.model = cuts, binned.pruned(feature, counts, weights), cut, shares
        return self

    def _probabilities(self, df: DataFrame) -> DataFrame:
        """Mean class shares of the leaves that a row falls into."""
        if self.model is None:
            return super()._probabilities(df)
        voted = df.withColumn("__p", binned.forest_shares(*self.model, self.depth)(vector_to_array("features")))
        return voted.withColumn("__code", (F.array_position("__p", F.array_max("__p")) - 1).cast("double"))


class Boosted(Classifier):
    """Boosted trees by the rules of Spark ML's ``GBTClassifier`` (logistic loss, ``bins`` bins, least squares on its slopes), one against the rest
    where there are more than two classes, grown by ``boosting.boost``. Sums do not depend on the order of rows beyond rounding.

    The driver holds the cuts, at most ``2**depth`` for a class and round."""

    def __init__(self, rounds: int = 300, depth: int = 5, step: float = 0.05, bins: int = binned.BINS, weighted: bool = True, key: str = "row_id", small: int = boosting.SMALL):
        self.rounds, self.depth, self.step, self.bins, self.weighted, self.key, self.small = rounds, depth, step, bins, weighted, key, small

    def fit(self, train: DataFrame) -> "Boosted":
        own = _level_counts(train)
        self.classes, self.model, n = list(own), None, sum(own.values())
        if len(own) == 1:
            return self
        width, count = vector_width(train), np.array(list(own.values()))
        weights = n / (len(count) * count) if self.weighted else np.ones(len(count))
        rows = _binnable(train, self.classes, self.key)
        cuts = binned.cut_points(rows, width, n, self.bins, weights=weights)
        targets = list(range(len(own))) if len(own) > 2 else [1]
        self.model = cuts, *boosting.boost(rows, n, cuts, weights, targets, self.rounds, self.depth, self.step, self.small)
        return self

    def _probabilities(self, df: DataFrame) -> DataFrame:
        """The logistic of each margin; of several classes as shares of their sum."""
        if self.model is None:
            return super()._probabilities(df)
        margin = boosting.margins(*self.model, self.depth)(vector_to_array("features"))
        out = df.withColumn("__e", F.transform(margin, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m))))
        if len(self.classes) == 2:
            p = F.array(F.lit(1.0) - F.get("__e", F.lit(0)), F.get("__e", F.lit(0)))
        else:
            p = F.transform("__e", lambda e: e / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("__p", p).drop("__e")
        return out.withColumn("__code", (F.array_position("__p", F.array_max("__p")) - 1).cast("double"))


class DenseNet(Classifier):
    """Dense net by the rules of Spark ML's ``MultilayerPerceptronClassifier`` (same first weights, layers, loss and steps), fitted by ``net.fitted``.

    Every row weighs the same here; in Spark ML a row of an incomplete block weighs more. The driver holds the weights."""

    def __init__(self, hidden: tuple[int, ...] = (128, 64, 32), max_iter: int = 300, tol: float = 1e-6, seed: int = SEED):
        self.hidden, self.max_iter, self.tol, self.seed = hidden, max_iter, tol, seed

    def _start(self, spark, sizes: list[int]) -> np.ndarray:
        """The weights that Spark ML begins with: those of a fit without steps."""
        row = spark.range(1).select(F.lit(0.0).alias("label"), array_to_vector(F.array(*[F.lit(0.0)] * sizes[0])).alias("features"))
        return MultilayerPerceptronClassifier(layers=sizes, maxIter=0, seed=self.seed).fit(row).weights.toArray()

    def fit(self, train: DataFrame) -> "DenseNet":
        own = _level_counts(train)
        self.classes, self.model, n = list(own), None, sum(own.values())
        if len(own) == 1:
            return self
        sizes = [vector_width(train), *self.hidden, len(own)]
        rows = _with_code(train, self.classes).select(vector_to_array("features").alias("x"), F.col("__code").cast("int").alias("code"))
        self.model = net.fitted(rows, n, sizes, self._start(train.sparkSession, sizes), self.max_iter, self.tol), sizes
        return self

    def _probabilities(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return super()._probabilities(df)
        out = df.withColumn("__p", net.shares(*self.model)(vector_to_array("features")))
        return out.withColumn("__code", (F.array_position("__p", F.array_max("__p")) - 1).cast("double"))


class StratifiedRandom:
    """Draws a level from the class shares of the training rows; the draw depends on the row key only."""

    def __init__(self, key: str = "row_id", seed: int = SEED):
        self.key, self.seed = key, seed

    def fit(self, train: DataFrame) -> "StratifiedRandom":
        counts = _level_counts(train)
        total, acc, self.cdf = sum(counts.values()), 0, []
        for level, n in counts.items():
            acc += n
            self.cdf.append((level, acc / total))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        u = draw(self.key, self.seed)
        pick = None
        for level, upto in self.cdf[:-1]:
            pick = F.when(u < upto, level) if pick is None else pick.when(u < upto, level)
        last = F.lit(self.cdf[-1][0])
        y = last if pick is None else pick.otherwise(last)
        return df.withColumn("y_pred", y).withColumn("score", (F.col("y_pred") >= 1).cast("double"))


class HardVote:
    """Majority of the members' levels, the smallest level on ties."""

    def __init__(self, members: list[Callable[[], object]]):
        self.members = members

    def fit(self, train: DataFrame) -> "HardVote":
        self.models = in_threads(train.sparkSession, [lambda m=m: m().fit(train) for m in self.members])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out, votes = df, []
        for i, m in enumerate(self.models):
            out = m.predict(out).withColumnRenamed("y_pred", f"__v{i}").drop("score")
            votes.append(F.col(f"__v{i}"))
        n = {c: sum((F.when(v == c, 1).otherwise(0) for v in votes), F.lit(0)) for c in SEVERITY_LEVELS}
        best = F.greatest(*n.values())
        y = None
        for c in SEVERITY_LEVELS:
            y = F.when(n[c] == best, c) if y is None else y.when(n[c] == best, c)
        share = sum((F.when(v >= 1, 1.0).otherwise(0.0) for v in votes), F.lit(0.0)) / F.lit(float(len(votes)))
        return out.withColumns({"y_pred": y, "score": share}).drop(*[f"__v{i}" for i in range(len(votes))])


class Stacking:
    """Out-of-fold class probabilities of the members feed a ridge classifier: a penalised least-squares fit of
    +1 / -1 per class, the class of the largest value wins (the first one on ties).

    Folds come from a draw on the row key, so every row gets its out-of-fold prediction exactly once."""

    def __init__(self, members: list[Callable[[], Classifier]], folds: int = 3, key: str = "row_id", seed: int = SEED, alpha: float = 1.0):
        self.members, self.folds, self.key, self.seed, self.alpha = members, folds, key, seed, alpha

    def _meta(self, df: DataFrame, models: list[Classifier]) -> DataFrame:
        out, parts = df, []
        for i, m in enumerate(models):
            out = m._probabilities(out).drop("__code").withColumnRenamed("__p", f"__m{i}")
            at = [F.coalesce(F.get(f"__m{i}", F.lit(m.classes.index(c))), F.lit(0.0)) if c in m.classes else F.lit(0.0)
                  for c in self.classes]
            parts.append(F.array(*at))
        return (out.withColumn("__meta", array_to_vector(F.concat(*parts)))
                .drop(*[f"__m{i}" for i in range(len(models))]))

    def fit(self, train: DataFrame) -> "Stacking":
        self.classes = _classes(train)
        f = F.floor(draw(self.key, self.seed) * self.folds).cast("int")
        rows, oof = train.withColumn("__fold", f), None
        tables = [rows.filter(F.col("__fold") != k) for k in range(self.folds)] + [train]
        fitted = in_threads(train.sparkSession, [lambda m=m, t=t: m().fit(t) for t in tables for m in self.members])
        *inner, self.models = [fitted[i:i + len(self.members)] for i in range(0, len(fitted), len(self.members))]
        for k in range(self.folds):
            part = self._meta(rows.filter(F.col("__fold") == k), inner[k])
            oof = part if oof is None else oof.unionByName(part)
        self.meta = []
        oof = stored(oof.select("__meta", "y"))
        for i, c in enumerate(self.classes):
            rows = oof.withColumn("__t", F.when(F.col("y") == c, 1.0).otherwise(-1.0))
            n, sd = rows.agg(F.count("*"), F.stddev_pop("__t")).first()
            est = LinearRegression(featuresCol="__meta", labelCol="__t", predictionCol=f"__d{i}", solver="normal",
                                   standardization=False, regParam=self.alpha * sd / n)
            self.meta.append(est.fit(rows))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self._meta(df, self.models)
        for m in self.meta:
            out = m.transform(out)
        value = {c: F.col(f"__d{i}") for i, c in enumerate(self.classes)}
        best = F.array_max(F.array(*value.values()))
        code = F.array_position(F.array(*value.values()), best) - 1
        absent = [v for c, v in value.items() if c < 1] or [F.lit(-1.0)]
        present = [v for c, v in value.items() if c >= 1] or [F.lit(-1.0)]
        margin = F.array_max(F.array(*present)) - F.array_max(F.array(*absent))
        return out.withColumns({"y_pred": _decode(code, self.classes), "score": presence_from_score(margin + 0.5)}).drop(
            "__meta", *[f"__d{i}" for i in range(len(self.classes))])


# --- registry ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ModelSpec:
    framing: str
    complexity: int
    make: Callable[[], object]


def _forest(trees: int, **kw):
    return lambda n, k: RandomForestClassifier(numTrees=trees, seed=SEED, **kw)


def _boosted(rounds: int, depth: int, step: float = 0.05, **kw):
    return lambda n, k: GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=SEED, **kw)


def registry(trees: int = 300, boosting_rounds: int | None = None, key: str = "row_id", max_iter: int = 300) -> dict[str, ModelSpec]:
    """The fourteen models of the extended benchmark with framing and complexity (ranking tie-break)."""
    b = boosting_rounds or trees
    leafwise = lambda r=b: Boosted(r, 5, key=key)
    symmetric = lambda r=b: Boosted(r, 6, key=key)
    histogram = lambda r=b: Boosted(r, 5, bins=64, key=key)
    depthwise = lambda r=b: Boosted(r, 6, weighted=False, key=key)
    fewer = max(1, b * 2 // 3)
    return {
        "dummy_stratified": ModelSpec("multiclass", 0, lambda: StratifiedRandom(key)),
        "regression_ordinale": ModelSpec("regression", 1, Ridge),
        "random_forest": ModelSpec("multiclass", 3, lambda: Forest(trees, 12, key=key)),
        "xgboost": ModelSpec("multiclass", 4, depthwise),
        "lightgbm": ModelSpec("multiclass", 4, leafwise),
        "catboost": ModelSpec("multiclass", 4, symmetric),
        "histgb": ModelSpec("multiclass", 3, histogram),
        "extra_trees": ModelSpec("multiclass", 3, lambda: ExtraTrees(trees)),
        "gradient_boosting": ModelSpec("multiclass", 4, lambda: Boosted(fewer, 4, weighted=False, key=key)),
        "mlp": ModelSpec("multiclass", 4, lambda: DenseNet(max_iter=max_iter)),
        "mord_logistic_at": ModelSpec("regression", 2, AllThresholdLogistic),
        "mord_ridge": ModelSpec("regression", 2, Ridge),
        "voting_ensemble": ModelSpec("multiclass", 5, lambda: HardVote([leafwise, symmetric, histogram])),
        "stacking": ModelSpec("multiclass", 6, lambda: Stacking(
            [lambda: leafwise(fewer), lambda: symmetric(fewer), lambda: histogram(fewer)], key=key)),
    }


def complexities(models: dict[str, ModelSpec]) -> dict[str, int]:
    return {n: s.complexity for n, s in models.items()}


def fit_predict(spec: ModelSpec, train: DataFrame, test: DataFrame) -> DataFrame:
    return spec.make().fit(train).predict(test)


#: What a model may fail with; other errors are faults of the code and pass.
MODEL_ERRORS = (PySparkException, Py4JError, ArithmeticError, ValueError, RuntimeError, np.linalg.LinAlgError)
_LEDGER = "modele string, campagne_calc string, path string"


def benchmark(df: DataFrame, models: dict[str, ModelSpec], campaign: str = "campagne_calc", row_id: str = "row_id", folder: str | None = None,
              prepare: Callable[[DataFrame, str], DataFrame] | None = None, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """Walk-forward benchmark: ``(detail, predictions)``.

    ``df`` is the assembled observed table, or what ``prepare`` (rows, test season) assembles for each fold. The fits of all models and
    seasons are independent jobs over filtered views of one cached table, ``at_once`` of them at a time. The predictions of each are
    written as they are made, then the pair is entered in a ledger beside them: a run that is started again with the same ``folder`` only
    does the pairs that are not in it. A model that fails, also while it predicts, leaves a row of NULL metrics with the reason
    (``erreur``), is not entered and is tried again by the next run; the others go on. No fold gives an empty report."""
    spark, folder = df.sparkSession, folder or scratch_dir(df.sparkSession, "predictions")
    ledger = f"{folder}/ledger"
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(ledger)
    done = {(r["modele"], r["campagne_calc"]): r["path"] for r in spark.read.schema(_LEDGER).parquet(ledger).collect()}
    df, entering = df.persist(), Lock()

    def one(name: str, spec: ModelSpec, train_camps: list[str], test_camp: str):
        train, test = df.filter(F.col(campaign).isin(train_camps)), df.filter(F.col(campaign) == test_camp)
        if prepare:
            train, test = prepare(train, test_camp), prepare(test, test_camp)
        path = f"{folder}/predictions/{name}/{test_camp}"
        try:
            fit_predict(spec, train, test).select(
                F.lit(name).alias("modele"), F.col(campaign).alias("campagne_calc"), F.col(row_id).alias("row_id"),
                F.col("y").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"),
                F.col("score").cast("double").alias("score")).write.mode("overwrite").parquet(path)
        except MODEL_ERRORS as e:  # one model must not stop the benchmark
            return name, test_camp, None, None, f"{type(e).__name__}: {str(e).strip()[:300]}"
        with entering:  # appends to one folder do not mix
            spark.createDataFrame([(name, test_camp, path)], _LEDGER).coalesce(1).write.mode("append").parquet(ledger)
            done[name, test_camp] = path

    try:
        folds = fold_list(walk_forward_folds(df, campaign))
        wanted = {(name, test) for _, test in folds for name in models}
        jobs = [lambda n=name, m=spec, tr=train, te=test: one(n, m, tr, te) for train, test in folds for name, spec in models.items() if (name, test) not in done]
        failed = [f for f in in_threads(spark, jobs, at_once) if f]
    finally:
        df.unpersist()
    written = [path for pair, path in done.items() if pair in wanted]
    schema = f"modele string, campagne_calc string, row_id {dict(df.dtypes)[row_id]}, y_true int, y_pred int, score double"
    preds = spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)
    detail = ordinal_report(preds, ("modele", "campagne_calc")).drop("n").withColumn("erreur", F.lit(None).cast("string"))
    nulls = spark.createDataFrame(failed, "modele string, campagne_calc string, qwk double, recall_23 double, erreur string")
    return detail.unionByName(nulls) if failed else detail, preds


def predict_target(table: DataFrame, features: list[str], medians: DataFrame, campaign: Column, spec: ModelSpec,
                   label: str = "severite") -> DataFrame:
    """Trains on every observed row and predicts the prediction surface of the target campaign."""
    filled = with_median_fill(table, features, medians)
    train = assemble(filled.filter(F.col(label).isNotNull()), features, label)
    target = assemble(filled.filter(F.col("a_predire") & (F.col("campagne_calc") == campaign)), features, None)
    out = fit_predict(spec, train, target)
    return out.select("cell_id", "AIRE_CODE", "campagne_calc", "campagne_decade", F.col("y_pred").alias("severite"),
                      F.col("score").alias("proba_presence"), (F.col("y_pred") >= 1).cast("int").alias("presence"))


# --- two-stage models -----------------------------------------------------------------------------------------

class PresenceModel:
    """Boosted presence classifier: positives weighted by negatives over positives, a stratified hold-out
    stops the boosting."""

    def __init__(self, rounds: int = 300, depth: int = 5, key: str = "row_id", step: float = 0.05):
        self.rounds, self.depth, self.key, self.step = rounds, depth, key, step

    def fit(self, train: DataFrame) -> "PresenceModel":
        w = positive_weight(train, "label").first()["scale_pos_weight"]
        rows = stratified_holdout(train.withColumn("label", F.col("label").cast("double")), self.key, "label")
        rows = rows.withColumn("__w", F.when(F.col("label") == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
        self.model = GBTClassifier(labelCol="label", weightCol="__w", validationIndicatorCol="is_holdout", maxIter=self.rounds,
                                   maxDepth=self.depth, stepSize=self.step, seed=SEED).fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return (self.model.transform(df).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
                .drop("rawPrediction", "probability", "prediction"))


class AbsoluteBoosting:
    """Boosted trees on absolute error: each tree is grown on the signs of the residuals, and each of its leaves then gives the exact
    median of the residuals in it. Starts from the median of the label.

    With a hold-out column the error on its rows is followed: after ``patience`` rounds without a better one the boosting stops and
    keeps the rounds up to the best. Rows without a label are left out; without rows that is an error. Each round starts from a
    stored table, so lineage stays short; the driver sees the medians of at most 2^depth leaves."""

    def __init__(self, rounds: int = 300, depth: int = 5, step: float = 0.05, patience: int = 30):
        self.rounds, self.depth, self.step, self.patience = rounds, depth, step, patience

    def fit(self, train: DataFrame, label: str, holdout: str | None = None) -> "AbsoluteBoosting":
        held = F.coalesce(F.col(holdout), F.lit(False)) if holdout else F.lit(False)
        rows = stored(train.select("features", F.col(label).cast("double").alias("__y"), held.alias("__held")).filter("__y is not null"))
        first = exact_median(rows.filter("not __held"), "__y").first()
        if first is None or first["median"] is None:
            raise ValueError("no rows to fit")
        self.start, self.trees, self.errors = first["median"], [], []
        state = rows.withColumn("__f", F.lit(self.start))
        error = F.avg(F.when(F.col("__held"), F.abs(F.col("__y") - F.col("__f"))))
        best, kept = state.agg(error.alias("e")).first()["e"], 0
        grower = DecisionTreeRegressor(labelCol="__sign", predictionCol="__p", leafCol="__leaf", maxDepth=self.depth, seed=SEED)
        for _ in range(self.rounds):
            signs = state.withColumn("__sign", F.signum(F.col("__y") - F.col("__f")))
            tree = grower.fit(signs.filter("not __held"))
            leaves = tree.transform(signs).withColumn("__r", F.col("__y") - F.col("__f")).select("features", "__y", "__held", "__f", "__leaf", "__r")
            medians = {int(r["__leaf"]): r["median"] for r in exact_median(leaves.filter("not __held"), "__r", ["__leaf"]).collect()}
            if not any(medians.values()):
                break  # no leaf moves its rows any more
            self.trees.append((tree, medians))
            state = stored(leaves.withColumn("__f", F.col("__f") + self._shift(medians)).drop("__leaf", "__r"))
            if best is None:
                continue
            self.errors.append(state.agg(error.alias("e")).first()["e"])
            if self.errors[-1] < best:
                best, kept = self.errors[-1], len(self.trees)
            elif len(self.trees) - kept >= self.patience:
                break
        if best is not None:
            self.trees = self.trees[:kept]
        return self

    def _shift(self, medians: dict[int, float]) -> Column:
        values = F.create_map(*[F.lit(x) for leaf, m in sorted(medians.items()) for x in (leaf, self.step * m)])
        return F.coalesce(F.try_element_at(values, F.col("__leaf").cast("int")), F.lit(0.0))

    def predict(self, df: DataFrame, to: str) -> DataFrame:
        out = df.withColumn("__f", F.lit(self.start))
        for tree, medians in self.trees:
            out = tree.transform(out).withColumn("__f", F.col("__f") + self._shift(medians)).drop("__p", "__leaf")
        return out.withColumnRenamed("__f", to)


class DensityModel:
    """Boosted density regressor on absolute error, over presence rows with a density; a fifth of the rows stops it.

    Without a row to train on there is no model, and the density of every row is unknown (NULL)."""

    def __init__(self, rounds: int = 300, depth: int = 5, key: str = "row_id", step: float = 0.05):
        self.rounds, self.depth, self.key, self.step = rounds, depth, key, step

    def fit(self, train: DataFrame) -> "DensityModel":
        rows = train.withColumn("is_holdout", draw(self.key, SEED) < 0.2)
        if rows.filter("not is_holdout and densite_imago_median is not null").isEmpty():
            self.inner = None
            return self
        self.inner = AbsoluteBoosting(self.rounds, self.depth, self.step).fit(rows, "densite_imago_median", "is_holdout")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.inner is None:
            return df.withColumn("densite_pred", F.lit(None).cast("double"))
        return self.inner.predict(df, "densite_pred")


class PhaseModel:
    """Balanced four-phase classifier, stopped on a stratified hold-out; predictions add ``phase_p`` over the fixed phases."""

    def __init__(self, rounds: int = 300, depth: int = 5, step: float = 0.05, key: str = "row_id"):
        self.inner = StoppedOneVsRest(rounds, depth, step, key)

    def fit(self, train: DataFrame) -> "PhaseModel":
        rows = train.withColumn("y", category_code("niveau_gregarite_dominant", PHASES)).filter("y is not null")
        self.inner.fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        c = self.inner.classes
        p = [F.coalesce(F.get("__p", F.lit(c.index(i))), F.lit(0.0)) if i in c else F.lit(0.0) for i in range(len(PHASES))]
        return self.inner._probabilities(df).withColumn("phase_p", F.array(*p)).drop("__p", "__code")


def predict_hierarchical(df: DataFrame, presence: PresenceModel, density: DensityModel, phase: PhaseModel,
                         threshold: float, threshold_g: float, keys: list[str]) -> DataFrame:
    """Presence first; a predicted absence leaves density and phase NULL."""
    scored = phase.predict(density.predict(presence.predict(df)))
    here = F.col("score") >= threshold
    name = F.get(F.array(*[F.lit(p) for p in PHASES]), thresholded_phase("phase_p", F.lit(threshold_g)))
    return scored.select(*keys, here.cast("int").alias("presence_pred"), F.when(here, F.col("densite_pred")).alias("densite_pred"),
                         F.when(here, name).alias("phase_pred"))


def searched_thresholds(train: DataFrame, held: DataFrame, presence: Callable[[], PresenceModel], phase: Callable[[], PhaseModel]) -> tuple[float, float]:
    """``(presence, G)``: the thresholds of the chain, searched on rows that the models were not fitted on.

    The one of presence has the best F1 on the labeled ``held`` rows, the one of G the best recall at a macro F1 of 0.30 or more on their
    presence rows with a phase. Without such rows, or without two classes to fit, the defaults of the searches stand."""
    if train.select("label").filter("label is not null").distinct().count() < 2:
        seen = held.limit(0).withColumn("score", F.lit(0.0))
    else:
        seen = presence().fit(train).predict(held)
    threshold = best_f1_threshold(seen.filter("label is not null")).first()["threshold"]
    known = F.col("niveau_gregarite_dominant").isin(*PHASES) & (F.col("label") == 1)
    rows = train.filter(known)
    if rows.select("niveau_gregarite_dominant").distinct().count() < 2:
        scored = held.limit(0).select(F.array(*[F.lit(0.0) for _ in PHASES]).alias("phase_p"), F.lit(0).alias("y_true"))
    else:
        scored = phase().fit(rows).predict(held.filter(known)).withColumn("y_true", category_code("niveau_gregarite_dominant", PHASES))
    return threshold, best_target_threshold(scored, "phase_p").first()["threshold_G"]


def fold_sizes(df: DataFrame, folds: DataFrame, campaign: str = "campagne_calc") -> DataFrame:
    """Row and class counts per fold and the gates for the density and phase fits."""
    pres = F.col("label") == 1
    den = pres & F.col("densite_imago_median").isNotNull()
    ph = pres & F.col("niveau_gregarite_dominant").isin(*PHASES)
    tr, te = F.col("role") == "train", F.col("role") == "test"
    rows = fold_rows(df, folds.select("fold_id", "role", "campagne"), campaign)
    return (rows.groupBy("fold_id").agg(
        F.count_if(tr & den).alias("den_train"), F.count_if(te & den).alias("den_val"),
        F.count_if(tr & ph).alias("ph_train"), F.count_if(te & ph).alias("ph_val"),
        F.count_distinct(F.when(tr & ph, F.col("niveau_gregarite_dominant"))).alias("ph_classes"))
        .withColumns({"fit_density": (F.col("den_train") >= 10) & (F.col("den_val") >= 2),
                      "fit_phase": (F.col("ph_train") >= 10) & (F.col("ph_val") >= 2) & (F.col("ph_classes") >= 2)}))


def walk_forward_presence(df: DataFrame, folds: list[tuple[list[str], str]], make: Callable[[], PresenceModel],
                          features: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Presence folds: ``(report with GLOBAL row, predictions, importances)``; ``features`` names the entries of the vector in the
    importances ``(campagne_calc, feature, importance)``, which are called by their numbers without it."""
    preds, imps = df.limit(0).select("campagne_calc", "row_id", "label", F.lit(0.0).alias("score")), []
    for train_camps, test_camp in folds:
        m = make().fit(df.filter(F.col("campagne_calc").isin(train_camps)))
        p = m.predict(df.filter(F.col("campagne_calc") == test_camp)).select("campagne_calc", "row_id", "label", "score")
        preds = preds.unionByName(p)
        weights = m.model.featureImportances.toArray()
        imps += [(test_camp, n, float(v)) for n, v in zip(features or map(str, range(len(weights))), weights, strict=True)]
    importances = df.sparkSession.createDataFrame(imps, "campagne_calc string, feature string, importance double")
    return binary_report_with_global(preds), preds, importances


def walk_forward_two_stage(df: DataFrame, folds: list[tuple[list[str], str]], gates: dict[str, tuple[bool, bool]],
                           density: Callable[[], DensityModel], phase: Callable[[], PhaseModel]) -> DataFrame:
    """Density and phase metrics per campaign and pooled; folds too small for a fit have NULL metrics."""
    dens, phs = [], []
    pres = df.filter("label = 1")
    for train_camps, test_camp in folds:
        tr, te = pres.filter(F.col("campagne_calc").isin(train_camps)), pres.filter(F.col("campagne_calc") == test_camp)
        fit_den, fit_ph = gates[test_camp]
        if fit_den:
            m = density().fit(tr.filter("densite_imago_median is not null"))
            dens.append(m.predict(te.filter("densite_imago_median is not null")).select("campagne_calc", "densite_imago_median", "densite_pred"))
        if fit_ph:
            ok = F.col("niveau_gregarite_dominant").isin(*PHASES)
            m = phase().fit(tr.filter(ok))
            phs.append(m.predict(te.filter(ok)).select("campagne_calc", category_code("niveau_gregarite_dominant", PHASES).alias("y_true"), "phase_p"))
    shown = [test for _, test in folds] + ["GLOBAL"]  # the pooled row counts every labeled presence
    out = (with_global(pres).groupBy("campagne_calc").agg(F.count("*").alias("n_presence"))
           .filter(F.col("campagne_calc").isin(shown)))
    if dens:
        u = dens[0]
        for d in dens[1:]:
            u = u.unionByName(d)
        out = out.join(regression_errors(with_global(u), "densite_imago_median", "densite_pred", ["campagne_calc"]), "campagne_calc", "left")
    if phs:
        u = phs[0]
        for d in phs[1:]:
            u = u.unionByName(d)
        rows = with_global(u)
        t = best_target_threshold(rows, "phase_p", "y_true", ["campagne_calc"])
        named = rows.join(t, "campagne_calc").withColumn("y_pred", thresholded_phase("phase_p", F.col("threshold_G")))
        out = out.join(phase_report(named, keys=["campagne_calc"]).join(t.withColumn("threshold_G", F.round("threshold_G", 4)), "campagne_calc"), "campagne_calc", "left")
    return out


