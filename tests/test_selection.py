import itertools

import pytest

from cellseason.operators import selection as sel
from cellseason.operators import training as tr

from .conftest import rows

SUMMARY = "modele string, recall_23 double, qwk double, variance_inter_folds double, pire_campagne double, complexite int"


def model(name, recall=0.5, qwk=0.6, var=0.01, worst=0.4, cx=2):
    return (name, recall, qwk, var, worst, cx)


def ranked(spark, models, base):
    return [r["modele"] for r in sel.rank_robust(spark.createDataFrame(models, SUMMARY), base).orderBy("rang").collect()]


def test_ranking_order_and_filter(spark):
    assert ranked(spark, [model("a", 0.4), model("b", 0.7)], 0.5) == ["b", "a"]
    assert ranked(spark, [model("a", var=0.02), model("b", var=0.01)], 0.5) == ["b", "a"]
    assert ranked(spark, [model("a", worst=0.1), model("b", worst=0.3)], 0.5) == ["b", "a"]
    assert ranked(spark, [model("a", cx=4), model("b", cx=1)], 0.5) == ["b", "a"]
    assert ranked(spark, [model("a", qwk=0.5), model("b", qwk=0.49)], 0.5) == ["a"]
    assert ranked(spark, [model("a", qwk=None), model("b", qwk=float("nan"))], 0.0) == []


def seasons(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "campagne_calc string")


def test_folds_are_chronological_and_skip(spark):
    assert tr.fold_list(tr.walk_forward_folds(seasons(spark, "2023-2024", "2024-2025", "2022-2023"))) == [(["2022-2023"], "2024-2025")]
    assert tr.fold_list(tr.walk_forward_folds(seasons(spark, "2022-2023"))) == []
    folds = tr.fold_list(tr.walk_forward_folds(seasons(spark, "2003-2004", "2001-2002", "2002-2003", "2001-2002")))
    assert folds == [(["2001-2002"], "2002-2003"), (["2001-2002", "2002-2003"], "2003-2004")]


def test_split_folds(spark):
    df = spark.createDataFrame([("2001-2002", "train"), ("2002-2003", "train"), ("2004-2005", "validation"), ("2003-2004", "validation"), ("2005-2006", "inference")],
                               "campagne_calc string, split string")
    assert tr.fold_list(tr.split_folds(df).drop("split")) == [(["2001-2002", "2002-2003"], "2003-2004"), (["2001-2002", "2002-2003", "2003-2004"], "2004-2005")]


def test_weights(spark):
    y = [0] * 70 + [1] * 18 + [2] * 6 + [3] * 6
    df = spark.createDataFrame([(v,) for v in y], "severite int")
    got = {r["severite"]: r["weight"] for r in tr.class_weights(df).collect()}
    assert got[0] == pytest.approx(100 / 280) and got[3] == pytest.approx(100 / 24)
    assert tr.with_class_weight(df).filter("class_weight is null").isEmpty()
    lab = spark.createDataFrame([(v,) for v in (1, 1, 0, 0, 0, 0)], "label int")
    assert tr.positive_weight(lab).first()[0] == 2.0 and tr.positive_weight(lab.filter("label = 0")).first()[0] == 1.0


def test_holdout_shares(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id bigint, label int")
    out = tr.stratified_holdout(df, "id", "label")
    assert {(r["label"], r["is_holdout"]): r["count"] for r in out.groupBy("label", "is_holdout").count().collect()} == {
        (0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}


def test_robustness_ignores_nulls(spark):
    df = spark.createDataFrame([(0.5, 0.2, None), (0.7, None, None), (None, 0.4, 0.9)], "qwk double, recall_23 double, auc_binaire double")
    r = sel.robustness(df).first().asDict()
    assert (r["qwk_moyen"], r["qwk_variance_inter_folds"], r["qwk_pire_campagne"]) == (0.6, 0.01, 0.5)
    assert r["recall_23_pire_campagne"] == 0.2 and r["auc_binaire_variance_inter_folds"] == 0.0


def exact_p(diffs):
    """Two-sided exact signed-rank p by listing all sign patterns (no zeros, no ties)."""
    ranks = {d: i + 1 for i, d in enumerate(sorted(diffs, key=abs))}
    n = len(diffs)
    w = min(sum(ranks[d] for d in diffs if d > 0), sum(ranks[d] for d in diffs if d < 0))
    hits = sum(sum(i + 1 for i, s in enumerate(p) if s) <= w for p in itertools.product((0, 1), repeat=n))
    return w, min(1.0, 2 * hits / 2**n)


def wilcoxon(spark, a, b):
    data = [("a", f"c{i}", v) for i, v in enumerate(a)] + [("b", f"c{i}", v) for i, v in enumerate(b)]
    return sel.wilcoxon_pairs(spark.createDataFrame(data, "modele string, campagne_calc string, recall_23 double")).first()


def test_signed_rank(spark):
    a, b = [0.9, 0.8, 0.7, 0.65, 0.5, 0.95, 0.44], [0.5, 0.6, 0.64, 0.7, 0.2, 0.45, 0.41]
    w, p = exact_p([round(x - y, 12) for x, y in zip(a, b)])
    r = wilcoxon(spark, a, b)
    assert (r["n_paires"], r["statistic"], r["p_value"]) == (7, w, round(p, 4)) and r["significatif_05"] == (p < 0.05)
    few = wilcoxon(spark, [0.1, 0.2], [0.3, 0.1])
    assert few["p_value"] is None and few["significatif_05"] is False
    flat = wilcoxon(spark, [0.5] * 6, [0.5] * 6)
    assert (flat["statistic"], flat["p_value"]) == (0.0, 1.0)
    # ties and zeros: z = (10.5 - 0) ... all positive, d = 1,1,2,2,3,3 (+ one zero): W = 0, var = (6*7*13 - 18/2)/24
    tied = wilcoxon(spark, [0.1, 0.1, 0.2, 0.2, 0.3, 0.3, 0.5], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5])
    z = 10.5 / ((6 * 7 * 13 - 18 / 2) / 24) ** 0.5
    from math import erfc, sqrt
    assert tied["p_value"] == pytest.approx(erfc(z / sqrt(2)), abs=1e-4)


def test_bootstrap_bounds(spark):
    data = [("m", f"c{i}", v) for i, v in enumerate([0.2, 0.4, 0.6, 0.8])] + [("n", "c0", 0.5), ("n", "c1", 0.5)]
    got = {r["modele"]: r for r in sel.bootstrap_interval(spark.createDataFrame(data, "modele string, campagne_calc string, recall_23 double")).collect()}
    assert got["m"]["recall_mean"] == 0.5 and 0.2 <= got["m"]["ci_low"] < 0.5 < got["m"]["ci_high"] <= 0.8
    assert got["n"]["recall_mean"] is None


def test_deployment(spark):
    cand = lambda a: spark.createDataFrame([("decadaire", a, 0.5)], "horizon string, auc_global double, f1_global double")
    base = spark.createDataFrame([(0.7, 0.5)], "auc_global double, f1_global double")
    first = lambda c, b, t: sel.deployment_decision(c, b, t).first()["decision"]
    assert first(cand(0.8), base, 10.0) == "deploy" and first(cand(0.6), base, 10.0) == "keep_baseline"
    assert first(cand(0.8), base, 45.0) == "keep_baseline" and first(cand(None), base, 10.0) == "keep_baseline"
    assert first(cand(0.8), None, 10.0) == "indeterminate"
    assert rows(sel.campaign_drilldown(spark.createDataFrame([("a", "x", 0.1, 0.2), ("b", "x", 0.3, 0.9), ("c", "y", 0.1, 0.1)],
                "modele string, campagne_calc string, qwk double, recall_23 double"), "x")) == [("b", 0.3, 0.9), ("a", 0.1, 0.2)]
