"""The segmentation as one saved PipelineModel."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridsift.operators import clustering, features
from gridsift.operators.pipeline import segmentation
from gridsift.operators.scaling import fit_components
from gridsift.schema import KEY, VALUE
from gridsift.sources.generator import synthetic_panel


@pytest.fixture(scope="module")
def fitted(spark):
    panel = synthetic_panel(spark, 24, 5).persist()
    return panel, segmentation(ks=(2, 4), restarts=2).fit(panel)


def test_stages_do_what_the_operators_do(spark, fitted):
    panel, model = fitted
    from gridsift.functions.calendar import with_calendar

    rows = features.consumer_features(with_calendar(panel))
    found = fit_components(rows)
    table, models = clustering.sweep(found.scores(rows).persist(), range(2, 5), restarts=2)
    want = {r[KEY]: r["cluster"] for r in clustering.label(found.scores(rows), models[clustering.choose_k(table)]).collect()}
    assert {r[KEY]: r["cluster"] for r in model.transform(panel).collect()} == want


def test_saved_and_loaded_model_scores_another_panel(spark, fitted, tmp_path):
    _, model = fitted
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    other = synthetic_panel(spark, 9, 3, seed=5).drop("voltage_v").withColumn(VALUE, F.when(F.col(KEY) != 3, F.col(VALUE)))
    a, b = (sorted((r[KEY], r["cluster"], tuple(r["pc"])) for r in m.transform(other).collect()) for m in (model, loaded))
    assert a == b and len(a) == 9
    assert loaded.transform(other.where("false")).count() == 0
