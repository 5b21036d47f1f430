import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cellseason.constants import PHASES
from cellseason.operators import models, panel, training

from .conftest import rows

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(42)
    data = []
    for c in range(3):
        for i in range(40):
            f = [rnd.gauss(0, 1) for _ in range(3)]
            sev = int(min(3, max(0, round(f[0] + f[1] + 1.5))))
            data.append((c * 100 + i, f"cell{i}", f"{2001 + c}-{2002 + c}", *f, sev))
    df = spark.createDataFrame(data, "row_id bigint, cell_id string, campagne_calc string, f0 double, f1 double, f2 double, severite int")
    return models.assemble(df, FEATURES).cache()


def agreement(pred):
    return pred.agg(F.avg((F.abs(F.col("y") - F.col("y_pred")) <= 1).cast("double"))).first()[0]


def weighted(table):
    return training.with_class_weight(table, "y").select(vector_to_array("features").alias("x"), "y", "class_weight").collect()


def test_weights_are_those_of_the_rows_of_the_fit(table):
    fold = table.filter("campagne_calc < '2003-2004' and not (y = 3 and f0 < 1.2)")
    whole = {r["y"]: r["class_weight"] for r in weighted(table)}
    own = {r["y"]: r["class_weight"] for r in weighted(fold)}
    assert abs(own[3] - whole[3]) > 0.5
    test_ridge_equals_the_weighted_normal_equations(fold)


def test_more_levels_than_the_scale_has_are_refused(table):
    with pytest.raises(ValueError, match="levels"):
        models.StratifiedRandom().fit(table.withColumn("y", F.col("row_id").cast("int")))


def test_ridge_equals_the_weighted_normal_equations(table):
    m = models.Ridge(alpha=1.0).fit(table)
    rowsx = weighted(table)
    x, y, w = np.array([r[0] for r in rowsx]), np.array([r[1] for r in rowsx], float), np.array([r[2] for r in rowsx])
    xm, ym = (w[:, None] * x).sum(0) / w.sum(), (w * y).sum() / w.sum()
    xc = x - xm
    beta = np.linalg.solve(xc.T @ (w[:, None] * xc) + np.eye(3), xc.T @ (w * (y - ym)))
    assert np.allclose(m.model.coefficients.toArray(), beta, atol=1e-6)
    assert m.model.intercept == pytest.approx(ym - xm @ beta, abs=1e-6)


def test_all_threshold_model_is_near_the_optimum(table):
    m = models.AllThresholdLogistic().fit(table)
    assert len(m.thresholds) == 3 and m.thresholds == sorted(m.thresholds, reverse=True)
    got = weighted(table)
    x, y, w = np.array([r[0] for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got])

    def loss(b, t):
        s = x @ b
        total = 0.5 * (b @ b)
        for k, th in enumerate(t):
            sign = np.where(y > k, 1.0, -1.0)
            total += (w * np.log1p(np.exp(-sign * (s + th)))).sum()
        return total

    b, t = np.array(m.slopes), np.array(m.thresholds)
    at = loss(b, t)
    rnd = np.random.default_rng(0)
    assert all(loss(b + rnd.normal(0, 0.05, 3), t + rnd.normal(0, 0.05, 3)) > at - 1e-3 for _ in range(200))
    assert agreement(m.predict(table)) > 0.95


def test_small_registry_predicts_levels(table):
    reg = models.registry(trees=3, boosting_rounds=2, max_iter=20)
    assert len(reg) == 14 and {s.framing for s in reg.values()} == {"regression", "multiclass"}
    assert models.complexities(reg)["dummy_stratified"] < models.complexities(reg)["regression_ordinale"] < models.complexities(reg)["stacking"]
    for name in ("regression_ordinale", "mord_ridge", "random_forest", "extra_trees", "gradient_boosting", "mlp", "dummy_stratified"):
        out = models.fit_predict(reg[name], table, table)
        assert out.count() == 120
        assert out.filter("y_pred not between 0 and 3 or y_pred is null or score not between -1e-9 and 1 + 1e-9").isEmpty(), name
        assert agreement(out) > (0.4 if name == "dummy_stratified" else 0.7), name


def test_missing_level_is_re_encoded(table):
    out = models.fit_predict(models.registry(trees=3)["random_forest"], table.filter("y in (0, 3)"), table)
    assert {r[0] for r in out.select("y_pred").distinct().collect()} <= {0, 3}


class _Const:
    def __init__(self, col):
        self.col = col

    def fit(self, train):
        return self

    def predict(self, df):
        return df.withColumns({"y_pred": F.col(self.col), "score": F.lit(0.0)})


def test_vote_takes_the_majority_and_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 1, 3), (0, 2, 2), (3, 1, 2)], "a int, b int, c int")
    vote = models.HardVote([lambda: _Const("a"), lambda: _Const("b"), lambda: _Const("c")]).fit(df)
    assert [r["y_pred"] for r in vote.predict(df).collect()] == [1, 2, 1]


def test_stacking_runs_out_of_fold(table):
    member = lambda: models.Classifier(models._forest(3, maxDepth=4))
    out = models.Stacking([member, member]).fit(table).predict(table)
    assert out.count() == 120 and agreement(out) > 0.7


def test_benchmark_survives_a_failing_model(table):
    def broken():
        raise RuntimeError("no")

    class Late:
        def fit(self, train):
            return self

        def predict(self, df):  # fails when the rows are made, not when the plan is
            return df.withColumns({"y_pred": F.raise_error(F.lit("no")).cast("int"), "score": F.lit(0.0)})

    specs = {"regression_ordinale": models.registry()["regression_ordinale"], "broken": models.ModelSpec("multiclass", 9, broken),
             "late": models.ModelSpec("multiclass", 9, Late)}
    detail, preds = models.benchmark(table, specs)
    got = {(r["modele"], r["campagne_calc"]): (r["recall_23"], r["erreur"]) for r in detail.collect()}
    assert len(got) == 6 and got[("broken", "2003-2004")] == (None, "RuntimeError: no") and got[("regression_ordinale", "2003-2004")][0] is not None
    assert got[("late", "2002-2003")][0] is None and got[("late", "2002-2003")][1]
    assert preds.count() == 80
    one = table.filter("campagne_calc = '2001-2002'")  # no fold
    detail, preds = models.benchmark(one, specs)
    assert detail.count() == preds.count() == 0


def test_a_killed_benchmark_goes_on_where_it_stopped(table, tmp_path):
    calls = []

    def counted(stop_after):
        class Model(models.Ridge):
            def fit(self, train):
                if len(calls) == stop_after:
                    raise KeyboardInterrupt  # not an error of the model: the run ends
                calls.append(1)
                return super().fit(train)
        return {"a": models.ModelSpec("regression", 1, Model), "b": models.registry()["regression_ordinale"]}

    folder = str(tmp_path / "run")
    with pytest.raises(KeyboardInterrupt):
        models.benchmark(table, counted(1), folder=folder, at_once=1)
    detail, preds = models.benchmark(table, counted(99), folder=folder)
    assert detail.count() == 4 and preds.count() == 160 and len(calls) == 2  # the finished fold of the first run was not fitted again
    models.benchmark(table, counted(99), folder=folder)
    assert len(calls) == 2
    both = {r["modele"]: r["q"] for r in detail.groupBy("modele").agg(F.sum("qwk").alias("q")).collect()}
    assert both["a"] == both["b"]


def test_faults_of_the_code_pass(table):
    class Wrong:
        def fit(self, train):
            return undefined_name  # noqa: F821

    with pytest.raises(NameError):
        models.benchmark(table, {"wrong": models.ModelSpec("regression", 1, Wrong)})


def test_all_ridge_folds_equal_single_fits(table):
    preds, fits = models.walk_forward_ridge(table)
    for train, test in training.fold_list(training.walk_forward_folds(table)):
        one = models.Ridge().fit(table.filter(F.col("campagne_calc").isin(train)))
        assert fits[test].intercept == pytest.approx(one.model.intercept, abs=1e-9)
        assert np.allclose(fits[test].coefficients.toArray(), one.model.coefficients.toArray(), atol=1e-9)
        a = {r["row_id"]: (r["y_pred"], r["score"]) for r in preds.filter(F.col("campagne_calc") == test).collect()}
        b = {r["row_id"]: (r["y_pred"], r["score"]) for r in one.predict(table.filter(F.col("campagne_calc") == test)).collect()}
        assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-9) for k in a)


def test_one_scan_gives_the_sums_of_all_seasons(table):
    from cellseason.operators import linear

    plan = linear.moments(table, vector_to_array("features"), 3, F.col("y"), ["campagne_calc", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") + plan.count("ObjectHashAggregate") >= 2


def test_sums_of_products_come_by_line_and_leave_nulls_out(spark):
    from cellseason.operators import linear

    df = spark.createDataFrame([("a", [1.0, 2.0], 3.0), ("a", [4.0, None], 5.0), ("a", [6.0, 7.0], None), ("b", None, 2.0)], "k string, x array<double>, y double")
    sums = linear.moments(df, F.col("x"), 2, F.col("y"), ["k"])
    assert sums.select("line").distinct().count() == 4  # a line of the matrix in a row
    got = linear.matrices(sums, ["k"], 2)
    assert got[("a",)].tolist() == [[3, 11, 9, 8], [11, 53, 44, 23], [9, 44, 53, 6], [8, 23, 6, 34]]
    assert linear.matrices(linear.moments(df.limit(0), F.col("x"), 2, F.col("y")), [], 2) == {}
    with pytest.raises(ValueError):
        linear.matrices(sums, ["k"], 2, most=1)


def test_panel_fit_equals_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rnd = random.Random(5)
    data = [(str(e), f"20{y:02d}-{m:02d}-11", rnd.random() + y * 0.1) for e in range(3) for y in range(1, 9) for m in (1, 3, 10, 12)]
    df = spark.createDataFrame(data, "ID string, d string, y double").select("ID", F.col("d").cast("date").alias("ds"), "y")
    m = panel.PanelModel(origin="2001-01-01")
    cols = panel.seasonal_columns(F.col("ds"), m.origin, m.knots, m.order)
    rowsx = VectorAssembler(inputCols=list(cols), outputCol="x").transform(df.withColumns(cols))
    lib = LinearRegression(featuresCol="x", labelCol="y", regParam=m.reg, solver="normal").fit(rowsx)
    assert np.allclose(m.fit(df).fitted.coefficients.toArray(), lib.coefficients.toArray(), atol=1e-8)
    assert m.fitted.intercept == pytest.approx(lib.intercept, abs=1e-8)


def test_noise_stops_each_class_early_on_a_stratified_holdout(spark):
    rnd = random.Random(3)
    data = []
    for i in range(400):
        x, noise = rnd.random(), rnd.random()
        data.append((i, x, noise, 0 if x < 0.5 else rnd.choice([1, 2, 2, 2])))  # class 0 is plain, 1 and 2 are noise
    df = models.assemble(spark.createDataFrame(data, "row_id bigint, x double, z double, y int"), ["x", "z"], None)
    m = models.StoppedOneVsRest(rounds=60, depth=3).fit(df)
    assert set(m.rounds_kept) == {0, 1, 2} and m.rounds_kept[0] > 2 * max(m.rounds_kept[1], m.rounds_kept[2]) and max(m.rounds_kept[1], m.rounds_kept[2]) < 60
    marked = training.stratified_holdout(df, "row_id", "y")
    for r in marked.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_holdout").alias("h")).collect():
        assert r["h"] == round(r["n"] * 0.2)
    p = m._probabilities(df).select("__p", "__code").collect()
    assert all(sum(r[0]) == pytest.approx(1) and r[0][int(r[1])] == max(r[0]) for r in p)
    one = models.StoppedOneVsRest().fit(df.filter("y = 0"))
    assert one.rounds_kept == {} and one.predict(df).filter("y_pred <> 0").isEmpty()


@pytest.fixture(scope="module")
def regions(spark):
    rnd = random.Random(7)
    data = []
    for i in range(300):
        x = rnd.random()
        lab = int(x > 0.5)
        data.append((i, x, rnd.random(), lab, x * 100 if lab else None, PHASES[min(3, int((x - 0.5) * 8))] if lab else None))
    df = spark.createDataFrame(data, "row_id bigint, x double, z double, label int, densite_imago_median double, niveau_gregarite_dominant string")
    return models.assemble(df, ["x", "z"], None).cache()


def test_two_stage_models_and_short_circuit(regions):
    pres = regions.filter("label = 1")
    m1, m2, m3 = models.PresenceModel(rounds=5, depth=3).fit(regions), models.DensityModel(rounds=8, depth=3).fit(pres), models.PhaseModel(rounds=5, depth=3).fit(pres)
    out = models.predict_hierarchical(regions, m1, m2, m3, 0.5, 0.4, ["row_id", "label"])
    assert out.filter("presence_pred = 0 and (densite_pred is not null or phase_pred is not null)").isEmpty()
    assert out.filter("presence_pred = 1 and (densite_pred is null or phase_pred is null)").isEmpty()
    assert out.agg(F.avg((F.col("presence_pred") == F.col("label")).cast("double"))).first()[0] > 0.9
    assert {r[0] for r in out.select("phase_pred").distinct().collect()} <= {None, *PHASES}


PANEL = "rn_num bigint, campagne_calc string, campagne_decade int, split string, label int"


def test_panel_is_complete_and_forecasts_shift(spark):
    data = [(r, f"{y}-{y + 1}", d, "train" if y < 2018 else "validation", int((d + r) % 3 == 0)) for r in (11, 12) for y in (2016, 2017, 2018) for d in (1, 10, 20)]
    df = spark.createDataFrame(data, PANEL)
    p = panel.complete_panel(df)
    assert p.count() == 2 * 3 * 30 and p.filter("y is not null").count() == 18 and p.select("ID", "ds").distinct().count() == 180
    pre = spark.createDataFrame([("a", f"2001-10-{d:02d}", 1.0, float(d)) for d in (1, 11, 21)], "ID string, ds string, y double, yhat1 double")
    pre = pre.withColumn("yhat3", F.col("yhat1") * 10)
    got = rows(panel.shift_forecast(pre, {"d": 1, "m": 3, "s": 10}).select("pred_1", "pred_3", "pred_10", "ds"), "ds")
    assert [g[:3] for g in got] == [(None, None, None), (1.0, None, 1.0), (11.0, None, 11.0)]
    rep, pooled = panel.walk_forward_panel(df, ["2018-2019"], model=lambda: panel.PanelModel(origin="2016-10-01"))
    assert {(r["campagne_calc"], r["horizon"]) for r in rep.collect()} == {(c, h) for c in ("2018-2019", "GLOBAL") for h in ("decadaire", "mensuel", "saisonnier")}
    assert pooled.count() == 60
    rep, pooled = panel.walk_forward_panel(df, [])
    assert rep.count() == pooled.count() == 0


def test_thresholds_are_searched_on_held_rows(regions):
    train, held = regions.filter("row_id % 3 > 0"), regions.filter("row_id % 3 = 0")
    make = (lambda: models.PresenceModel(rounds=3, depth=2), lambda: models.PhaseModel(rounds=2, depth=2))
    low, low_g = models.searched_thresholds(train, held, *make)
    scored = [(r["score"], r["label"]) for r in make[0]().fit(train).predict(held).collect()]

    def f1(t):
        tp, fp, fn = (sum(1 for s, y in scored if (s >= t, y) == c) for c in ((True, 1), (True, 0), (False, 1)))
        return 2 * tp / (2 * tp + fp + fn) if tp + fp else -1

    assert f1(low) == max(f1(0.05 + 0.01 * i + 1e-9) for i in range(46)) and 0.05 <= low <= 0.5 and 0.05 <= low_g <= 0.5
    assert models.searched_thresholds(train.filter("label = 0 or niveau_gregarite_dominant = 'G'"), held, *make)[1] == 0.15


def test_importances_of_folds_carry_names(regions):
    df = regions.withColumn("campagne_calc", F.when(F.col("row_id") % 2 == 0, "2001-2002").otherwise("2002-2003"))
    _, _, imp = models.walk_forward_presence(df, [(["2001-2002"], "2002-2003")], lambda: models.PresenceModel(rounds=2, depth=2), ["x", "z"])
    got = {r["feature"]: r["importance"] for r in imp.collect()}
    assert set(got) == {"x", "z"} and got["x"] > got["z"] >= 0 and abs(sum(got.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        models.walk_forward_presence(df, [(["2001-2002"], "2002-2003")], lambda: models.PresenceModel(rounds=1, depth=1), ["x"])


def test_extra_trees_draw_their_cuts_inside_the_range_of_each_node(table):
    train, test = table.filter("campagne_calc < '2003-2004'"), table.filter("campagne_calc = '2003-2004'")
    fits = [models.ExtraTrees(trees=6, depth=4, seed=s).fit(train) for s in (1, 2, 1)]
    cuts = [{(r["tree"], r["node"]): (r["f"], r["cut"]) for r in m.splits.collect()} for m in fits]
    assert cuts[0] == cuts[2] and not set(cuts[0].values()) & set(cuts[1].values())
    roots = [c for (_, n), c in cuts[0].items() if n == 1]
    assert len(roots) == 6 and len(set(roots)) == 6
    data = weighted(train)
    codes = sorted({r["y"] for r in data})
    leaves = {(r["tree"], r["node"]): r["shares"] for r in fits[0].leaves.collect()}
    for tree in range(6):  # the rows, sent down by hand
        members: dict[int, list] = {}
        for r in data:
            n = 1
            members.setdefault(n, []).append(r)
            while (tree, n) in cuts[0]:
                f, cut = cuts[0][tree, n]
                n = 2 * n + (r["x"][f] > cut)
                members.setdefault(n, []).append(r)
        for n, rs in members.items():
            if (tree, n) in cuts[0]:
                f, cut = cuts[0][tree, n]
                values = sorted(r["x"][f] for r in rs)
                assert values[0] <= cut < values[-1] and n < 16
            else:
                total = sum(r["class_weight"] for r in rs)
                assert np.allclose(leaves.pop((tree, n)), [sum(r["class_weight"] for r in rs if r["y"] == c) / total for c in codes])
    assert not leaves
    got = fits[0].predict(test).select("row_id", "y_pred", "score").collect()
    assert len(got) == test.count() and all(0 <= r["score"] <= 1 for r in got)
    assert agreement(models.ExtraTrees(trees=30, depth=8).fit(train).predict(test)) > 0.8


def test_extra_trees_of_one_class_or_constant_features(table):
    one = table.filter("y = 1")
    assert {r[0] for r in models.ExtraTrees(trees=3).fit(one).predict(table).select("y_pred").collect()} == {1}
    flat = models.assemble(table.withColumns({f: F.lit(1.0) for f in FEATURES}).drop("features", "y"), FEATURES)
    model = models.ExtraTrees(trees=3).fit(flat)
    assert model.splits.isEmpty() and model.leaves.count() == 3 and model.predict(flat).count() == table.count()


def test_extra_trees_exchange_no_row_for_their_trees(table):
    train, test = table.filter("campagne_calc < '2003-2004'"), table.filter("campagne_calc = '2003-2004'")
    whole, parts = models.ExtraTrees(trees=5, depth=3).fit(train), models.ExtraTrees(trees=5, depth=3, at_once=2).fit(train)
    out = whole.predict(test)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace(test._jdf.queryExecution().executedPlan().toString(), "")
    read = lambda m: sorted(tuple(r) for r in m.splits.collect())
    assert read(whole) == read(parts)
    assert sorted((r["row_id"], r["score"]) for r in out.collect()) == sorted((r["row_id"], r["score"]) for r in parts.predict(test).collect())


def test_all_threshold_model_scans_each_row_once_and_ends_flat(table, monkeypatch):
    scans = []
    real = models.batches.summed
    monkeypatch.setattr(models.batches, "summed", lambda rows, *a: scans.append(rows.count()) or real(rows, *a))
    m = models.AllThresholdLogistic().fit(table)
    assert set(scans) == {table.count()} and len(scans) <= 20  # rows are not repeated by border, Newton steps are few
    got = weighted(table)
    x, y, w = np.array([r[0] for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got])
    slope = np.array(m.slopes)  # penalty 1
    for k, t in enumerate(m.thresholds):
        s = np.where(y > k, 1.0, -1.0)
        slope = slope - x.T @ (w * s / (1 + np.exp(s * (x @ m.slopes + t))))
    assert np.abs(slope).max() < 1e-2
