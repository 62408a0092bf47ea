from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsift.functions.calendar import with_calendar
from gridsift.functions.stats import bin_of, kurtosis_g2, skewness_g1
from gridsift.operators import features
from gridsift.schema import BEHAVIORAL, KEY, PERIOD_USAGE, SHAPE, TIME, VALUE
from gridsift.sources.tables import as_panel, read_csv, write_csv


def weekly(spark):
    """Two consumers over a week from a Monday: weekday, weekend factor and peak hour differ."""
    rows = []
    for key, weekday, weekend, peak in ((1, 2.0, 0.5, 12), (2, 1.0, 3.0, 20)):
        for h in range(168):
            t = datetime(2024, 1, 1) + timedelta(hours=h)
            rows.append((key, t, (weekend if t.weekday() >= 5 else weekday) * (2.0 if t.hour == peak else 0.5)))
    return with_calendar(spark.createDataFrame(rows, f"{KEY} long, {TIME} timestamp_ntz, {VALUE} double"))


def test_shapes_sum_to_one_and_ratios(spark):
    out = {r[KEY]: r for r in features.raw_features(weekly(spark), "behavioral").collect()}
    for r in out.values():
        assert sum(r[c] for c in SHAPE) == pytest.approx(1.0)
        assert r["peak_to_avg_ratio"] >= 1
    assert out[1]["weekend_ratio"] == pytest.approx(0.25) and out[2]["weekend_ratio"] == pytest.approx(3.0)
    assert out[1]["hour_12_shape"] > out[1]["hour_20_shape"]


def test_shape_ignores_scale(spark):
    a = features.raw_features(weekly(spark), "behavioral").orderBy(KEY).collect()
    b = features.raw_features(weekly(spark).withColumn(VALUE, F.col(VALUE) * 10), "behavioral").orderBy(KEY).collect()
    free = [c for c in BEHAVIORAL if c not in PERIOD_USAGE]
    assert all(x[c] == pytest.approx(y[c]) for x, y in zip(a, b, strict=True) for c in free)


def test_moments_match_pandas(spark):
    values = {1: [1.0, 2, 4, 8, 16], 2: [3.0, 3, 3, 3], 3: [1.0, 2], 4: [5.0, 1, 1, 9], 5: [7.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k int, x double")
    for r in df.groupBy("k").agg(skewness_g1("x").alias("s"), kurtosis_g2("x").alias("t")).collect():
        s = pd.Series(values[r["k"]])
        for got, want in ((r["s"], s.skew()), (r["t"], s.kurt())):
            assert got is None if pd.isna(want) else got == pytest.approx(want)


def test_missing_hours_weekends_and_zero_consumption(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 3), 0.0), (2, datetime(2024, 1, 1, 5), 4.0), (None, datetime(2024, 1, 1), 1.0)], f"{KEY} long, {TIME} timestamp_ntz, {VALUE} double")
    out = {r[KEY]: r for r in features.raw_features(with_calendar(rows), "combined").collect()}
    assert set(out) == {1, 2}
    assert out[1]["peak_to_avg_ratio"] is None and out[1]["hour_3_shape"] is None and out[2]["weekend_ratio"] is None
    assert out[2]["hour_5_shape"] == 1.0 and out[2][f"{VALUE}_median"] == 4.0


def test_constant_columns_go_before_nulls_become_zero(spark):
    table = features.consumer_features(weekly(spark))
    assert "hour_3_shape" not in table.columns or table.select("hour_3_shape").distinct().count() > 1
    assert "weekend_ratio" in table.columns and KEY in table.columns
    assert features.select_features(table, "behavioral").columns[0] == KEY
    assert features.select_features(features.raw_features(weekly(spark), "combined"), "scale").columns[1:] == [f"{VALUE}_{s}" for s in ("mean", "max", "min", "median", "std", "sum")]


def test_empty_panel(spark):
    empty = weekly(spark).where("false")
    assert features.raw_features(empty, "combined").count() == 0
    assert features.consumer_features(empty).columns == [KEY]
    with pytest.raises(ValueError):
        features.raw_features(empty, "other")


def test_hourly_means_are_the_wide_shapes(spark):
    long = features.hourly_means(weekly(spark)).where(f"{KEY} = 1").collect()
    wide = features.raw_features(weekly(spark), "behavioral").where(f"{KEY} = 1").first()
    assert all(r["share"] == pytest.approx(wide[f"hour_{r['hour']}_shape"]) for r in long)


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (None,)], "x double")
    assert [r[0] for r in df.select(bin_of(F.col("x"), F.lit(0.0), F.lit(10.0), 5)).collect()] == [1, 5, 5, None]
    assert df.limit(1).select(bin_of(F.col("x"), F.lit(0.0), F.lit(0.0), 5)).first()[0] == 1


def test_csv_round_trip(spark, tmp_path):
    rows = weekly(spark).select(KEY, TIME, VALUE)
    write_csv(rows, f"{tmp_path}/panel")
    again = read_csv(spark, f"{tmp_path}/panel", rows.schema)
    assert again.exceptAll(rows).count() == 0 and again.count() == rows.count()
    with pytest.raises(Exception):  # noqa: B017
        read_csv(spark, f"{tmp_path}/nowhere").count()


def test_nan_consumption_is_null(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), float("nan"))], "a long, b timestamp_ntz, c double")
    assert as_panel(df, "a", "b", "c").first()[VALUE] is None
