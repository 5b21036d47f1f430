import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellseason.constants import PHASES, THRESHOLDS
from cellseason.operators import metrics as m

from .conftest import rows


def frame(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id bigint, label int, score double")


def pair_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc(spark):
    assert m.auc(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()[0] == 1.0
    assert m.auc(frame(spark, [1, 1], [0.1, 0.2])).first()[0] is None
    rnd = random.Random(2)
    y = [rnd.randint(0, 1) for _ in range(400)]
    s = [round(rnd.random() * 0.7 + 0.3 * a, 1) for a in y]
    assert m.auc(frame(spark, y, s)).first()[0] == pytest.approx(pair_auc(y, s), abs=1e-12)


def test_precision_recall_zero_division(spark):
    assert tuple(m.precision_recall(frame(spark, [1, 0], [0.1, 0.2]), 0.9).first()) == (0.0, 0.0, 0.0)
    assert tuple(m.precision_recall(frame(spark, [1, 0, 1], [0.9, 0.8, 0.1]), 0.5).first()) == (0.5, 0.5, 0.5)


def brute_threshold(y, s):
    best, at = -1.0, 0.20
    for t in THRESHOLDS:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a)
        fp = sum(1 for a, b in zip(y, s) if b >= t and not a)
        fn = sum(y) - tp
        if tp + fp == 0:
            continue
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best:
            best, at = f1, t
    return at


def test_best_threshold(spark):
    rnd = random.Random(4)
    for _ in range(3):
        y = [rnd.randint(0, 1) for _ in range(60)]
        s = [rnd.random() * 0.4 + 0.2 * a for a in y]
        assert m.best_f1_threshold(frame(spark, y, s)).first()[0] == brute_threshold(y, s)
    assert m.best_f1_threshold(frame(spark, [1, 0], [0.01, 0.02])).first()[0] == 0.20
    assert np.allclose(THRESHOLDS, np.linspace(0.05, 0.50, 46), atol=0)


def test_kappa_and_recall(spark):
    df = spark.createDataFrame([(0, 3), (1, 3), (2, 2), (2, 0), (3, 3), (3, 1)], "y_true int, y_pred int")
    assert df.agg(m.recall_high()).first()[0] == 0.5
    same = spark.createDataFrame([(i % 4, i % 4) for i in range(12)], "y_true int, y_pred int")
    assert same.agg(m.quadratic_kappa()).first()[0] == 1.0
    flat = spark.createDataFrame([(2, 2), (2, 2)], "y_true int, y_pred int")
    assert flat.agg(m.quadratic_kappa()).first()[0] is None
    low = spark.createDataFrame([(0, 1), (1, 1)], "y_true int, y_pred int")
    assert low.agg(m.recall_high()).first()[0] is None


def test_calibration(spark):
    y = [1] * 2 + [0] * 8 + [1] * 8 + [0] * 2
    got = rows(m.calibration(frame(spark, y, [0.2] * 10 + [0.8] * 10)), "bin")
    assert [(g[0], round(g[1], 9), round(g[2], 9), g[3]) for g in got] == [(2, 0.2, 0.2, 10), (8, 0.8, 0.8, 10)]
    edge = rows(m.calibration(frame(spark, [1, 1, 1], [0.3, 0.30000000000000004, 1.0])), "bin")
    assert [e[0] for e in edge] == [2, 3, 9]


def brute_gain(y, s, bins):
    o = sorted(range(len(y)), key=lambda i: (-s[i], i))
    ys, n, pos, out = [y[i] for i in o], len(y), sum(y), []
    for b in range(1, bins + 1):
        end = n if b == bins else int(np.linspace(0, n, bins + 1)[b])
        if end:
            out.append((b, round(end / n, 4), round(sum(ys[:end]) / pos, 4), round(sum(ys[:end]) / pos / (end / n), 4)))
    return out


def test_gain_lift(spark):
    y, s = [int(i >= 80) for i in range(100)], [float(i) for i in range(100)]
    got = rows(m.gain_lift(frame(spark, y, s), "label", "score", "id"), "quantile")
    assert got[0][2:] == (0.5, 5.0) and got[-1][2] == 1.0
    rnd = random.Random(9)
    y = [rnd.randint(0, 1) for _ in range(333)]
    for levels in (1, 3, 50):  # one level: every row is tied
        s = [float(rnd.randrange(levels)) for _ in y]
        assert rows(m.gain_lift(frame(spark, y, s), "label", "score", "id"), "quantile") == brute_gain(y, s, 10)
    none = rows(m.gain_lift(frame(spark, [0] * 20, [float(i) for i in range(20)]), "label", "score", "id"), "quantile")
    assert len(none) == 10 and none[0][2] is None and none[0][3] is None


def brute_phase(y, p):
    g, n, best, at = 3, len(y), -1.0, 0.15
    for t in THRESHOLDS:
        pred = [g if q[g] >= t else max(range(3), key=lambda i: (q[i], -i)) for q in p]
        if sum(pred) == 0:
            continue
        f1s = []
        for c in sorted(set(y) | set(pred)):
            tp = sum(a == c and b == c for a, b in zip(y, pred))
            d = sum(a == c for a in y) + sum(b == c for b in pred)
            f1s.append(2 * tp / d if d else 0.0)
        if sum(f1s) / len(f1s) < 0.30:
            continue
        act = sum(a == g for a in y)
        rec = sum(a == g and b == g for a, b in zip(y, pred)) / act if act else 0.0
        if rec > best:
            best, at = rec, t
    return at


def test_target_threshold_against_brute_force(spark):
    rnd = random.Random(11)
    for tilt in (0.2, 0.8, 0.0):
        y = [rnd.randrange(4) for _ in range(80)]
        p = []
        for a in y:
            q = [rnd.random() + (tilt if i == a else 0) for i in range(4)]
            p.append([v / sum(q) for v in q])
        df = spark.createDataFrame(list(zip(y, p)), "y_true int, p array<double>")
        assert m.best_target_threshold(df, "p").first()[0] == brute_phase(y, p)
    assert PHASES[-1] == "G"


def test_phase_report_counts_missing_labels_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (3, 3), (3, 0)], "y_true int, y_pred int")
    f1_0, f1_3 = 2 * 2 / (2 + 3), 2 * 1 / (2 + 1)
    assert tuple(m.phase_report(df).first()) == (round((f1_0 + f1_3) / 4, 4), 0.5)


def test_confusion_is_complete(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (3, 3)], "y_true int, y_pred int")
    got = {(a, b): n for a, b, n in rows(m.confusion(df))}
    assert len(got) == 16 and got[(0, 1)] == 2 and got[(2, 2)] == 0


def test_agreement(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (4, 4), (4, 1)], "a int, b int")
    r = m.agreement(df, "a", "b").first()
    assert (r["n"], r["accord_exact"], r["accord_pm1"]) == (4, 0.5, 0.75) and r["kappa"] == pytest.approx((0.5 - 4 / 16) / (1 - 4 / 16))


def test_horizons(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (None, 0.5)], "y double, pred_1 double").withColumn("pred_3", F.lit(None).cast("double"))
    got = {r["horizon"]: r["auc_roc"] for r in m.horizon_report(df).collect()}
    assert got == {"decadaire": 1.0, "mensuel": None, "saisonnier": None}
    one = spark.createDataFrame([(1.0, 0.9), (1.0, 0.1)], "y double, pred_1 double")
    assert {r["auc_roc"] for r in m.horizon_report(one).collect()} == {None}


def test_global_row_is_recomputed(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("b", 1, 0.2), ("b", 0, 0.1)], "campagne_calc string, label int, score double")
    got = {r["campagne_calc"]: (r["auc_roc"], r["n_positifs"]) for r in m.binary_report_with_global(df).collect()}
    assert got == {"a": (1.0, 1), "b": (1.0, 1), "GLOBAL": (0.75, 2)}


def test_status(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.1, None)], "auc_roc double, recall_G double, f1 double, x double")
    got = {r["metric"]: r["status"] for r in m.target_status(df, {"auc_roc": 0.85, "recall_G": 0.7}).collect()}
    assert got == {"auc_roc": "reached", "recall_G": "missed", "f1": ""}
