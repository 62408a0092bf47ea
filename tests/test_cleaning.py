from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridsift.functions.calendar import parse_time, with_calendar
from gridsift.functions.quantiles import exact_quantiles
from gridsift.operators import cleaning
from gridsift.schema import KEY, TIME, VALUE

START = datetime(2024, 1, 1)
PANEL = f"{KEY} long, {TIME} timestamp_ntz, {VALUE} double"


def panel(spark, rows):
    return spark.createDataFrame([(k, None if h is None else START + timedelta(hours=h), v) for k, h, v in rows], PANEL)


def gap_panel(spark, parts=1):
    rows = [(k, h, None if h == 5 else v) for k, v in ((1, 111.0), (2, 222.0)) for h in range(10)]
    return panel(spark, rows[::-1]).repartition(parts)


@pytest.mark.parametrize("method", ["forward_fill", "backward_fill", "mean"])
@pytest.mark.parametrize("parts", [1, 8])
def test_fill_never_crosses_consumers(spark, method, parts):
    out = cleaning.impute(gap_panel(spark, parts), method, [VALUE])
    assert {(r[KEY], r[VALUE]) for r in out.collect()} == {(1, 111.0), (2, 222.0)}


def test_fill_direction_and_edges(spark):
    rows = panel(spark, [(1, 0, None), (1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (1, 4, None), (2, 0, None)])
    get = lambda df: [r[VALUE] for r in df.orderBy(KEY, TIME).collect()]
    assert get(cleaning.fill(rows, [VALUE])) == [1.0, 1.0, 1.0, 3.0, 3.0, None]
    assert get(cleaning.fill(rows, [VALUE], forward=False)) == [1.0, 1.0, 3.0, 3.0, 3.0, None]


def test_fill_ungrouped_carries_over_days(spark):
    rows = panel(spark, [(1, 0, None), (1, 10, 5.0), (1, 30, None), (1, 60, None), (1, 90, 7.0), (1, 100, None), (1, None, None)])
    out = cleaning.fill_ungrouped(rows, [VALUE]).orderBy(F.col(TIME).asc_nulls_last()).collect()
    assert [r[VALUE] for r in out] == [5.0, 5.0, 5.0, 5.0, 7.0, 7.0, 7.0]
    back = cleaning.impute(rows, "backward_fill", [VALUE], by=None).orderBy(F.col(TIME).asc_nulls_last()).collect()
    assert [r[VALUE] for r in back] == [5.0, 5.0, 7.0, 7.0, 7.0, 7.0, 7.0]


def test_mean_falls_back_to_mean_of_filled_rows(spark):
    rows = panel(spark, [(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (2, 0, None), (3, 0, 8.0)])
    out = {(r[KEY], r[TIME].hour): r[VALUE] for r in cleaning.fill_mean(rows, [VALUE]).collect()}
    assert out[1, 1] == 2.0 and out[2, 0] == pytest.approx((1 + 2 + 3 + 8) / 4)
    empty = cleaning.fill_mean(rows.where("false"), [VALUE])
    assert empty.count() == 0


def test_drop_and_unknown_method(spark):
    assert cleaning.impute(gap_panel(spark), "drop").count() == 18
    with pytest.raises(ValueError):
        cleaning.impute(gap_panel(spark), "magic")


def test_ranges_are_inclusive_and_nan_is_invalid(spark):
    rows = panel(spark, [(1, 0, 0.0), (1, 1, 1000.0), (1, 2, 1000.1), (1, 3, -0.1), (1, 4, None), (1, 5, float("nan"))])
    out = [r[VALUE] for r in cleaning.blank_invalid(rows).orderBy(TIME).collect()]
    assert out == [0.0, 1000.0, None, None, None, None]
    assert cleaning.invalid_counts(rows).first()[VALUE] == 3


def test_required_columns(spark):
    rows = gap_panel(spark)
    assert cleaning.require_columns(rows, [KEY]) is rows
    with pytest.raises(ValueError, match="voltage"):
        cleaning.require_columns(rows, ["voltage_v"])


def test_repeated_rows_with_nulls(spark):
    rows = panel(spark, [(1, 0, None), (1, 0, None), (1, 0, 1.0)])
    assert cleaning.drop_repeated_rows(rows).count() == 2


def test_times_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, "2024-01-06 13:00:00"), (2, "soon"), (3, None)], "id long, timestamp string")
    out = {r["id"]: r for r in with_calendar(parse_time(rows)).collect()}
    assert (out[1]["hour"], out[1]["day_of_week"], out[1]["is_weekend"], out[1]["month"]) == (13, 5, True, 1)
    assert out[2]["hour"] is None and out[2]["is_weekend"] is False and out[3]["timestamp"] is None
    assert with_calendar(rows.select("id")).columns == ["id"]


def test_outliers(spark):
    rows = panel(spark, [(1, h, float(v)) for h, v in enumerate([1, 2, 3, 4, 5, 100])])
    assert cleaning.without_outliers(rows, threshold=1.5).count() == 5
    assert cleaning.flag_outliers(rows, threshold=50.0).where("is_outlier").count() == 0
    assert cleaning.flag_outliers(rows, method="zscore", threshold=2.0).where("is_outlier").count() == 1
    same = panel(spark, [(1, h, 2.0) for h in range(4)])
    assert cleaning.flag_outliers(same, method="zscore").where("is_outlier").count() == 0
    assert cleaning.without_outliers(same.where("false")).count() == 0


def test_clean_ignores_order_and_partitions(spark):
    rows = gap_panel(spark).union(gap_panel(spark))
    a = cleaning.clean(rows.repartition(7, TIME)).orderBy(KEY, TIME).collect()
    b = cleaning.clean(rows.coalesce(1)).orderBy(KEY, TIME).collect()
    assert a == b and len(a) == 20 and all(r[VALUE] in (111.0, 222.0) for r in a)


def test_clean_and_features_exchange_once(spark):
    from gridsift.operators.features import raw_features

    plan = raw_features(cleaning.clean(gap_panel(spark)), "combined")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_match_numpy(spark, n):
    import numpy as np

    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(0, 2, n), 1)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, x double").repartition(5)
    for g in {0, 1} if n > 1 else {0}:
        own = x[g::2]
        got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.75, 1.0], ["g"]).where(F.col("g") == g).collect()}
        for p, v in got.items():
            assert v == pytest.approx(np.quantile(own, p))


def test_fills_of_a_long_consumer_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from gridsift.operators.cleaning import fill, fill_ungrouped
    from gridsift.schema import KEY, TIME, VALUE

    rows = spark.range(100_000).select(F.lit(1).alias(KEY), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias(TIME), F.when(F.col("id") == 50_000, 7.0).alias(VALUE))
    began = time.time()
    assert fill(rows, [VALUE]).where(f"{VALUE} = 7").count() == 100_000
    assert fill_ungrouped(rows, [VALUE]).where(f"{VALUE} = 7").count() == 100_000
    assert time.time() - began < 60


@pytest.mark.parametrize("few", [20_000, 0])
def test_quantiles_of_many_groups_and_one_large_one(spark, monkeypatch, few):
    """Brackets broadcast or joined; ties, infinities and a sketch that is far off."""
    import numpy as np

    from gridsift.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(4)
    rows = [(0, float(v)) for v in np.round(rng.normal(0, 3, 4_000), 1)] + [(g, float(v)) for g in range(1, 300) for v in rng.integers(0, 5, g % 7)]
    rows += [(None, 2.0), (None, 4.0), (500, None), (501, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(6)
    own = {}
    for g, v in rows:
        if v is not None and v == v:
            own.setdefault(g, []).append(v)
    for accuracy in (2_000, 5):
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        found = quantiles.exact_quantiles(df, ["x"], [0.25, 0.5], ["g"]).collect()
        assert {(r["g"], r["probability"]) for r in found} == {(g, p) for g in own for p in (0.25, 0.5)}
        assert all(r["value"] == pytest.approx(np.quantile(own[r["g"]], r["probability"])) for r in found)
    assert quantiles.exact_quantiles(df.where("false"), ["x"], [0.5], ["g"]).count() == 0


def test_no_row_of_a_group_reaches_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from gridsift.operators import exploration

    df = spark.range(2_000).select((F.col("id") % 700).alias("g"), F.rand(3).alias("x"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("collected"))
    boxes = exploration.box_statistics(df, "x", "g")
    monkeypatch.undo()
    assert boxes.count() == 700


def test_days_of_one_consumer_are_dealt_to_tasks(spark):
    """The days of one consumer spread; the result is that of ``fill``, over years, nulls and rows without time."""
    from pyspark.sql import functions as F

    rows = spark.range(6_000).select(
        F.when(F.col("id") % 50 != 0, F.lit(1)).alias(KEY), F.when(F.col("id") % 997 != 0, F.expr("timestamp_ntz'2022-11-01 00:00:00' + make_dt_interval(0, CAST(id * 5 AS INT), 0, 0)")).alias(TIME),
        F.when(F.col("id") % 800 == 3, F.col("id").cast("double")).alias(VALUE), "id",
    )
    for forward in (True, False):
        long = cleaning.fill_long(rows, [VALUE], forward=forward, order=[TIME, "id"])
        want = cleaning.fill(rows, [VALUE], forward=forward, order=[TIME, "id"])
        assert sorted(map(tuple, long.select("id", VALUE).collect())) == sorted(map(tuple, want.select("id", VALUE).collect()))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert f"{KEY}#" in plan and "_day" in plan and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") >= 1
    assert cleaning.fill_long(rows.where("false"), [VALUE]).count() == 0
