import pytest
from pyspark.sql import functions as F

from gridsift.operators import profiling

BASE = {
    "cluster": 0, "size": 1, "size_percentage": 100.0, "avg_consumption": 1.0, "avg_cv": 0.9, "avg_peak_to_avg": 6.0,
    "morning_usage": 0.1, "afternoon_usage": 0.1, "evening_usage": 0.1, "night_usage": 0.1, "weekend_ratio": 1.0,
}


def profiles(spark, *changes):
    rows = [tuple({**BASE, "cluster": i, **c}.values()) for i, c in enumerate(changes)]
    kinds = ", ".join(f"{k} {'int' if k == 'cluster' else 'long' if k == 'size' else 'double'}" for k in BASE)
    return spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize(
    ("change", "name"),
    [
        ({"weekend_ratio": 1.15}, "Weekend-Oriented Moderate-Variability"),
        ({"weekend_ratio": 0.85}, "Weekday-Oriented Moderate-Variability"),
        ({"weekend_ratio": 0.0}, "Evening-Peak Moderate-Variability"),
        ({}, "Evening-Peak Moderate-Variability"),
        ({"morning_usage": 0.2}, "Morning-Peak Moderate-Variability"),
        ({"afternoon_usage": 0.2, "night_usage": 0.2}, "Afternoon-Peak Moderate-Variability"),
        ({"night_usage": 0.2}, "Night-Peak Moderate-Variability"),
        ({f"{p}_usage": 0.0 for p in ("morning", "afternoon", "evening", "night")}, "Balanced-Timing Moderate-Variability"),
        ({"avg_peak_to_avg": 9.0}, "Evening-Peak Spiky-Variable"),
        ({"avg_cv": 1.2}, "Evening-Peak Spiky-Variable"),
        ({"avg_peak_to_avg": 5.0, "avg_cv": 0.8}, "Evening-Peak Flat-Stable"),
        ({"avg_cv": 1.0}, "Evening-Peak High-Variability"),
        ({"avg_cv": None, "avg_peak_to_avg": 4.0}, "Evening-Peak Flat-Stable"),
    ],
)
def test_names_at_thresholds(spark, change, name):
    assert profiling.named_profiles(profiles(spark, change)).first()["cluster_name"] == name


def test_scale_compares_with_the_median_of_clusters(spark):
    rows = profiling.named_profiles(profiles(spark, {"avg_consumption": 0.5}, {}, {"avg_consumption": 2.0}, {"avg_consumption": 1.0})).orderBy("cluster").collect()
    assert [r["cluster_name"].split()[0] for r in rows] == ["Lower-Scale", "Evening-Peak", "Higher-Scale", "Evening-Peak"]


def test_readings_and_advice(spark):
    rows = profiling.cluster_insights(profiles(spark, {"weekend_ratio": 0.7, "avg_cv": 0.3, "evening_usage": 0.6}, {"avg_consumption": 2.1, "avg_peak_to_avg": 2.0, "avg_cv": 0.2})).orderBy("cluster").collect()
    assert rows[0]["interpretation"] == "Moderate consumption consumers with moderate variability and significant peak loads with evening-heavy usage and weekday-oriented energy intensity"
    assert rows[0]["recommendations"].count("; ") == 5
    assert rows[1]["interpretation"] == "High consumption consumers with stable usage patterns"
    assert rows[1]["recommendations"].startswith("Consider energy efficiency audits")


def test_absent_weekend_column_counts_as_zero_in_advice(spark):
    got = profiling.cluster_insights(profiles(spark, {"avg_cv": 0.1, "avg_peak_to_avg": 1.0}).drop("weekend_ratio")).first()
    assert got["recommendations"] == "Weekday-dominant usage: Consider weekend load shifting"


def test_recommendations_rank_by_priority_and_category(spark):
    rows = profiling.recommendations(profiles(spark, {"avg_consumption": 2.5, "evening_usage": 0.9, "weekend_ratio": 1.3, "avg_peak_to_avg": 2.675})).orderBy("rank").collect()
    assert [r["category"] for r in rows] == ["consumption", "peak_management", "variability", "temporal", "temporal"]
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[0]["evidence"] == "Average consumption 2.50 kWh exceeds 2.0 kWh threshold"
    assert rows[3]["evidence"] == "Evening usage (0.900) is 9.0x higher than morning usage" and rows[0]["cluster_name"] == "Cluster 0"


def test_no_rule_gives_no_row_and_zero_morning_is_safe(spark):
    calm = {"avg_cv": 0.1, "avg_peak_to_avg": 1.0}
    assert profiling.recommendations(profiles(spark, calm)).count() == 0
    rows = profiling.recommendations(profiles(spark, calm | {"morning_usage": 0.0, "evening_usage": 0.7})).collect()
    assert len(rows) == 1 and "infinitely higher" in rows[0]["evidence"]


def test_profiles_join_by_key(spark):
    features = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "consumer_id long, coefficient_of_variation double")
    labels = spark.createDataFrame([(3, 0), (1, 1), (2, 1)], "consumer_id long, cluster int")
    rows = profiling.cluster_profiles(features, labels).orderBy("cluster").collect()
    assert [(r["size"], r["avg_cv"]) for r in rows] == [(1, 5.0), (2, 2.0)]
    assert sum(r["size_percentage"] for r in rows) == pytest.approx(100)
    assert profiling.cluster_profiles(features, labels).select(F.sum("size")).first()[0] == 3
