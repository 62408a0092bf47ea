"""Profiles of clusters, their names, readings and recommendations, as column expressions.

The texts and thresholds below are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.functions.stats import ratio
from gridsift.schema import KEY, VALUE

#: Column of a profile: the feature whose mean it is.
PROFILE = {
    "avg_consumption": f"{VALUE}_mean",
    "peak_consumption": f"{VALUE}_max",
    "min_consumption": f"{VALUE}_min",
    "consumption_std": f"{VALUE}_std",
    "avg_cv": "coefficient_of_variation",
    "avg_peak_to_avg": "peak_to_avg_ratio",
    "morning_usage": "morning_usage",
    "afternoon_usage": "afternoon_usage",
    "evening_usage": "evening_usage",
    "night_usage": "night_usage",
    "weekend_ratio": "weekend_ratio",
    "avg_temperature": "temperature_c_mean",
}
PRIORITIES = ["high", "medium", "low"]
CATEGORIES = ["consumption", "peak_management", "variability", "temporal"]


def cluster_profiles(features: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """(cluster, size, size_percentage, means...): features join labels by key, never by position."""
    rows = features.join(labels.select(key, "cluster"), key)
    means = [F.avg(f).alias(name) for name, f in PROFILE.items() if f in features.columns]
    counted = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *means)
    share = 100.0 * F.col("size") / F.sum("size").over(Window.partitionBy())
    return counted.withColumn("size_percentage", share).select("cluster", "size", "size_percentage", *(n for n, f in PROFILE.items() if f in features.columns))


def _of(profiles: DataFrame, name: str, default: float) -> Column:
    return F.col(name) if name in profiles.columns else F.lit(default)


def _or_zero(profiles: DataFrame, name: str) -> Column:
    return F.coalesce(_of(profiles, name, 0.0), F.lit(0.0))


def _choose(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for condition, text in reversed(cases):
        out = F.when(condition, text).otherwise(out)
    return out


def reading(profiles: DataFrame, *, older: bool = False) -> Column:
    """A sentence on a cluster: level, variability, peaks, time of day, weekends.

    ``older`` takes the weekend ratio as the share of rows on weekends, as the older rules do.
    """
    use, cv, peak = _of(profiles, "avg_consumption", 0.0), _of(profiles, "avg_cv", 0.0), _of(profiles, "avg_peak_to_avg", 1.0)
    morning, evening, night = (_of(profiles, f"{p}_usage", 0.0) for p in ("morning", "evening", "night"))
    weekend = _of(profiles, "weekend_ratio", 0.0 if older else 1.0)
    if older:
        days = ((weekend > 0.6, "and higher weekend activity"), (weekend < 0.4, "and higher weekday activity"))
    else:
        days = ((weekend > 1.15, "and weekend-oriented energy intensity"), (weekend < 0.85, "and weekday-oriented energy intensity"))
    return F.concat_ws(
        " ",
        _choose((use < 1.0, "Low consumption consumers"), (use < 1.5, "Moderate consumption consumers"), otherwise="High consumption consumers"),
        _choose((cv < 0.3, "with stable usage patterns"), (cv < 0.5, "with moderate variability"), otherwise="with highly variable usage"),
        _choose((peak > 2.0, "and significant peak loads")),
        _choose(
            ((morning > evening) & (morning > night), "with morning-heavy usage"),
            ((evening > morning) & (evening > night), "with evening-heavy usage"),
            ((night > morning) & (night > evening), "with night-heavy usage"),
        ),
        _choose(*days),
    )


def advice(profiles: DataFrame, *, older: bool = False) -> Column:
    """Recommendations of a cluster in one text, separated by ``; ``; empty if no rule applies.

    ``older`` has lower thresholds, no rule on weekends and three texts for every cluster.
    """
    much, varying, peaks, later = (1.5, 0.5, 2.0, 1.0) if older else (2.0, 0.6, 2.5, 1.5)
    use, cv, peak = _of(profiles, "avg_consumption", 0.0), _of(profiles, "avg_cv", 0.0), _of(profiles, "avg_peak_to_avg", 1.0)
    morning, evening, weekend = _of(profiles, "morning_usage", 0.0), _of(profiles, "evening_usage", 0.0), _of(profiles, "weekend_ratio", 0.0)
    return F.concat_ws(
        "; ",
        _choose((use > much, "Consider energy efficiency audits to identify reduction opportunities; Evaluate equipment upgrades for more efficient alternatives")),
        _choose((cv > varying, "Implement load monitoring to understand usage patterns; Consider energy storage to smooth demand fluctuations")),
        _choose(
            (peak > peaks, "Implement peak-load shifting strategies; Consider demand-response programs to reduce peak charges; Schedule high-energy tasks during off-peak hours")
        ),
        _choose(((evening > morning * later) & (evening > 0.5), "Consider shifting evening loads to earlier hours; Implement smart scheduling for appliances")),
        F.lit(
            "Install smart meters for real-time consumption monitoring; Set up automated alerts for unusual consumption patterns; Consider renewable energy integration where feasible"
        )
        if older
        else _choose(
            (weekend > 1.2, "Weekend-dominant usage: Consider time-of-use optimization"),
            (weekend < 0.8, "Weekday-dominant usage: Consider weekend load shifting"),
        ),
    )


def cluster_insights(profiles: DataFrame, *, older: bool = False) -> DataFrame:
    return profiles.select("cluster", reading(profiles, older=older).alias("interpretation"), advice(profiles, older=older).alias("recommendations"))


def name(profiles: DataFrame, population: Column) -> Column:
    """``[scale] time steadiness``; ``population`` is the level that the scale compares with."""
    raw = _or_zero(profiles, "weekend_ratio") if "weekend_ratio" in profiles.columns else F.lit(1.0)
    weekend = F.when(raw == 0, 1.0).otherwise(raw)
    use, cv, peak = _or_zero(profiles, "avg_consumption"), _or_zero(profiles, "avg_cv"), _or_zero(profiles, "avg_peak_to_avg")
    periods = {p: _or_zero(profiles, f"{p}_usage") for p in ("evening", "morning", "afternoon", "night")}
    top = F.greatest(*periods.values())
    primary = _choose(
        (weekend >= 1.15, "Weekend-Oriented"),
        (weekend <= 0.85, "Weekday-Oriented"),
        *(((c == top) & (c > 0), f"{p.capitalize()}-Peak") for p, c in periods.items()),
        otherwise="Balanced-Timing",
    )
    secondary = _choose(
        ((peak >= 9.0) | (cv >= 1.2), "Spiky-Variable"),
        ((peak <= 5.0) & (cv <= 0.8), "Flat-Stable"),
        (cv >= 1.0, "High-Variability"),
        otherwise="Moderate-Variability",
    )
    known = (population != 0) & (use > 0)
    scale = _choose((known & (use < 0.85 * population), "Lower-Scale"), (known & (use > 1.15 * population), "Higher-Scale"))
    return F.concat_ws(" ", scale, primary, secondary)


def named_profiles(profiles: DataFrame) -> DataFrame:
    """Adds ``cluster_name``; scales compare with the median of the clusters' mean consumption."""
    if "avg_consumption" in profiles.columns:
        population = F.median("avg_consumption").over(Window.partitionBy())
    else:
        population = F.lit(None).cast("double")
    return profiles.withColumn("_population", population).withColumn("cluster_name", name(profiles, F.col("_population"))).drop("_population")


def _rule(applies: Column, recommendation: str, evidence: Column, priority: str, category: str, number: int) -> Column:
    fields = F.struct(
        F.lit(PRIORITIES.index(priority)).alias("by_priority"),
        F.lit(CATEGORIES.index(category)).alias("by_category"),
        F.lit(number).alias("number"),
        F.lit(recommendation).alias("recommendation"),
        evidence.alias("evidence"),
        F.lit(priority).alias("priority"),
        F.lit(category).alias("category"),
    )
    return F.when(applies, fields)


def recommendations(profiles: DataFrame) -> DataFrame:
    """(cluster, cluster_name, recommendation, evidence, priority, category, rank) for rules that apply.

    Ranks order by priority, then category, then the order of the rules.  Numbers in the evidence
    are rounded half up before they are written.
    """
    use, cv, peak = _or_zero(profiles, "avg_consumption"), _or_zero(profiles, "avg_cv"), _of(profiles, "avg_peak_to_avg", 1.0)
    morning, evening, weekend = _or_zero(profiles, "morning_usage"), _or_zero(profiles, "evening_usage"), _of(profiles, "weekend_ratio", 1.0)
    two = lambda text, c: F.format_string(text, F.round(c, 2))
    higher = F.coalesce(F.format_string("%.1fx", F.round(ratio(evening, morning), 1)), F.lit("infinitely"))
    higher = F.when(ratio(evening, morning).isNull(), "infinitely").otherwise(higher)
    shifted = F.concat(F.format_string("Evening usage (%.3f) is ", F.round(evening, 3)), higher, F.lit(" higher than morning usage"))
    rules = F.array(
        _rule(use > 2.0, "Conduct energy efficiency audit", two("Average consumption %.2f kWh exceeds 2.0 kWh threshold", use), "high", "consumption", 1),
        _rule(cv > 0.6, "Implement load monitoring and energy storage", two("Coefficient of variation %.2f indicates high usage volatility", cv), "high", "variability", 2),
        _rule(peak > 2.5, "Implement peak-load shifting and demand-response programs", two("Peak-to-average ratio %.2f indicates significant peak loads", peak), "high", "peak_management", 3),
        _rule((evening > morning * 1.5) & (evening > 0.5), "Shift evening loads to off-peak hours", shifted, "medium", "temporal", 4),
        _rule(weekend > 1.2, "Optimize time-of-use scheduling for weekend patterns", two("Weekend-to-weekday ratio %.2f indicates weekend-dominant usage", weekend), "medium", "temporal", 5),
    )
    label = F.col("cluster_name") if "cluster_name" in profiles.columns else F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    found = F.sort_array(F.filter(rules, lambda r: r.isNotNull()))
    rows = profiles.select("cluster", label.alias("cluster_name"), F.posexplode(found).alias("at", "r"))
    return rows.select("cluster", "cluster_name", "r.recommendation", "r.evidence", "r.priority", "r.category", (F.col("at") + 1).alias("rank"))
