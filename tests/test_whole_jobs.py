"""Sizes of the models that the registered queries fit: those of the operators, nothing less."""

from types import SimpleNamespace

import pytest

from cellseason.operators import models
from cellseason.plans import catalog_models as plans
from cellseason.plans.registry import _QUERIES


class Asked(Exception):
    pass


@pytest.fixture
def bare(monkeypatch):
    """Queries without tables."""
    monkeypatch.setattr(plans, "observed", lambda v: None)
    monkeypatch.setattr(plans, "last_fold", lambda df: (None, None))
    return SimpleNamespace(spark=None)


def test_stacking_has_whole_members(bare, monkeypatch):
    def stacking(members):
        raise Asked([m() for m in members])

    monkeypatch.setattr(models, "Stacking", stacking)
    with pytest.raises(Asked) as found:
        _QUERIES["L11_stacking"](bare)
    forest, boosted = found.value.args[0]
    assert (forest.trees, forest.depth) == (300, 12) and (boosted.rounds, boosted.depth) == (200, 5)


def test_registry_query_fits_all_models_whole(bare, monkeypatch):
    def fit_predict(spec, train, test):
        raise Asked(spec)

    seen = []
    monkeypatch.setattr(models, "fit_predict", fit_predict)
    monkeypatch.setattr(models, "in_threads", lambda spark, jobs: [seen.append(pytest.raises(Asked, j).value.args[0].make()) for j in jobs] and (_ for _ in ()).throw(Asked))
    with pytest.raises(Asked):
        _QUERIES["L16_model_registry"](bare)
    assert len(seen) == 14
    assert {m.rounds for m in seen if isinstance(m, models.Boosted)} == {300, 200}
    assert {m.trees for m in seen if isinstance(m, (models.Forest, models.ExtraTrees))} == {300}
    assert [m.max_iter for m in seen if isinstance(m, models.DenseNet)] == [300]


def test_chain_of_models_is_allowed_all_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(plans, "region_stage", lambda v: spark.createDataFrame([], "split string, label int, densite_imago_median double, niveau_gregarite_dominant string"))
    monkeypatch.setattr(models, "searched_thresholds", lambda train, held, presence, phase: asked.extend([presence(), phase()]) or (0.5, 0.15))
    for kind in (models.PresenceModel, models.DensityModel, models.PhaseModel):
        monkeypatch.setattr(kind, "fit", lambda self, train: asked.append(self) or self)
    monkeypatch.setattr(models, "predict_hierarchical", lambda df, *a: (_ for _ in ()).throw(Asked))
    with pytest.raises(Asked):
        _QUERIES["L15_hierarchical"](SimpleNamespace(spark=spark))
    assert len(asked) == 5 and {((m.inner if isinstance(m, models.PhaseModel) else m).rounds, (m.inner if isinstance(m, models.PhaseModel) else m).depth) for m in asked} == {(300, 5)}
