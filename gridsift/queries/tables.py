"""Queries on descriptive tables, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators import exploration, features
from gridsift.queries.common import GAPPY, PANEL, gappy, moment_sql, panel, raw_features_sql, rounded, rounded_sql, table
from gridsift.schema import ARCHETYPE, BEHAVIORAL, KEY, SCALE, TIME, VALUE
from gridsift.sources.generator import TEMPLATES, synthetic_panel, templates

E = VALUE
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: All features of consumers, a constant column and one without values.
_NUMERIC = [*BEHAVIORAL, *(s for s in SCALE if s.startswith(VALUE)), "constant", "unknown"]


def hourly_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.hourly_profile(panel(spark, d)))


def weekend_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.weekend_profile(panel(spark, d)))


def consumer_cv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.consumer_variability(panel(spark, d)))


def describe_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.describe(table(spark, d, "lineitem"), _LINE), 5)


def describe_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.describe(gappy(spark, d), [E, "hour", "day_of_week"]), 5)


def correlation_long(spark: SparkSession, d: str) -> DataFrame:
    rows = features.raw_features(panel(spark, d)).withColumns({"constant": F.lit(1.5), "unknown": F.lit(None).cast("double")})
    return rounded(exploration.correlations(rows))


def archetype_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.archetype_statistics(panel(spark, d)))


def archetype_hour_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.archetype_profile(panel(spark, d)))


def archetype_variation(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    return rounded(exploration.archetype_profile(rows.join(exploration.first_consumers(rows).select(KEY).distinct(), KEY, "left_semi"), KEY))


def first_consumers(spark: SparkSession, d: str) -> DataFrame:
    return exploration.first_consumers(panel(spark, d)).select(ARCHETYPE, KEY, F.col("place").cast("int").alias("place"))


def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return exploration.overview(gappy(spark, d)).select("consumers", "rows", at("first_time"), at("last_time"), "missing")


def histogram30(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploration.histogram(panel(spark, d), E))


def histogram30_price(spark: SparkSession, d: str) -> DataFrame:
    return exploration.histogram(table(spark, d, "lineitem"), "l_extendedprice").select("bin", "n")


def _box(by: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(exploration.box_statistics(panel(spark, d), E, by))

    return run


def attach_archetype(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    return exploration.attach_archetype(features.hourly_means(rows).select(KEY, "hour"), rows).groupBy(ARCHETYPE).agg(F.count(F.lit(1)).alias("n"))


def archetype_templates(spark: SparkSession, d: str) -> DataFrame:
    """Customers given an archetype by their nation: what the customers of a nation use, hour by hour, by the templates."""
    kinds = F.array(*map(F.lit, TEMPLATES))
    named = table(spark, d, "customer").select("c_nationkey", F.get(kinds, F.col("c_nationkey") % 4).alias(ARCHETYPE))
    own = named.join(F.broadcast(templates(spark)), ARCHETYPE)  # 96 rows
    return rounded(own.groupBy("c_nationkey", ARCHETYPE, "hour").agg(F.count(F.lit(1)).alias("customers"), F.sum("share").alias("share")))


def generated_panel(spark: SparkSession, d: str) -> DataFrame:
    """A panel of as many consumers as there are suppliers; random, so only its counts can be checked: consumers, rows, floor and hours of each archetype."""
    rows = synthetic_panel(spark, table(spark, d, "supplier").count(), 14)
    return rows.groupBy(ARCHETYPE).agg(
        F.count_distinct(KEY).alias("consumers"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.col(E) >= 0.01).alias("above_floor"),
        F.count_distinct(TIME).alias("times"),
    )


QUERIES = {
    "hourly_profile": hourly_profile,
    "weekend_profile": weekend_profile,
    "consumer_cv": consumer_cv,
    "describe_all": describe_all,
    "describe_panel": describe_panel,
    "correlation_long": correlation_long,
    "archetype_stats": archetype_stats,
    "archetype_hour_profile": archetype_hour_profile,
    "archetype_variation": archetype_variation,
    "first_consumers": first_consumers,
    "dataset_overview": dataset_overview,
    "histogram30": histogram30,
    "histogram30_price": histogram30_price,
    "box_stats_hour": _box("hour"),
    "box_stats_day": _box("day_of_week"),
    "box_stats_weekend": _box("is_weekend"),
    "attach_archetype": attach_archetype,
    "archetype_templates": archetype_templates,
    "generated_panel": generated_panel,
}


def _describe(source: str, columns: list[str], digits: int = 5) -> str:
    parts = [
        f"SELECT '{c}' AS column, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, "
        f"CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, CAST(max({c}) AS DOUBLE) AS max, "
        f"{moment_sql('skewness', c, 3)}, {moment_sql('kurtosis', c, 4)} FROM {source}"
        for c in columns
    ]
    return rounded_sql(" UNION ALL ".join(parts), ["mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"], digits)


def _box_sql(by: str) -> str:
    return f"""WITH {PANEL}, q AS (SELECT {by}, quantile_cont({E}, 0.25) AS q1, quantile_cont({E}, 0.5) AS q2, quantile_cont({E}, 0.75) AS q3 FROM panel GROUP BY {by}),
        j AS (SELECT *, {E} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM panel JOIN q USING ({by}))
        SELECT {by}, round(q1, 6) + 0.0 AS q1, round(q2, 6) + 0.0 AS q2, round(q3, 6) + 0.0 AS q3, round(min({E}) FILTER (inside), 6) + 0.0 AS low_whisker,
          round(max({E}) FILTER (inside), 6) + 0.0 AS high_whisker, count(*) FILTER (NOT inside) AS outliers, count(*) AS n FROM j GROUP BY {by}, j.q1, j.q2, j.q3"""


def _bins(c: str) -> str:
    return f"least(30, 1 + CAST(floor(({c} - lo) * 30 / (hi - lo)) AS INTEGER))"


def _templates_sql() -> str:
    rows = ", ".join(f"('{a}', {i}, {first}, {after}, CAST({level} AS DOUBLE))" for i, (a, parts) in enumerate(TEMPLATES.items()) for first, after, level in parts)
    return f"""WITH t(archetype, place, a, b, level) AS (VALUES {rows}), h AS (SELECT archetype, place, CAST(hour AS INTEGER) AS hour, level FROM t, range(24) r(hour) WHERE hour >= a AND hour < b),
        s AS (SELECT *, level / sum(level) OVER (PARTITION BY archetype) AS share FROM h)
        SELECT c_nationkey, archetype, hour, count(*) AS customers, round(sum(share), 6) + 0.0 AS share FROM customer JOIN s ON c_nationkey % 4 = place GROUP BY ALL"""


_SHAPES = f"f AS ({raw_features_sql(scale=False)})"
ORACLES = {
    "hourly_profile": f"WITH {PANEL} SELECT hour, round(avg({E}), 6) + 0.0 AS mean_kwh FROM panel GROUP BY hour",
    "weekend_profile": f"WITH {PANEL} SELECT is_weekend, round(avg({E}), 6) + 0.0 AS mean_kwh FROM panel GROUP BY is_weekend",
    "consumer_cv": f"WITH {PANEL} " + rounded_sql(f"SELECT consumer_id, avg({E}) AS mean_kwh, stddev_samp({E}) AS std_kwh, stddev_samp({E}) / nullif(avg({E}), 0) AS cv FROM panel GROUP BY consumer_id", ["mean_kwh", "std_kwh", "cv"]),
    "describe_all": _describe("lineitem", _LINE),
    "describe_panel": f"WITH {PANEL}, {GAPPY} " + _describe("gappy", [E, "hour", "day_of_week"]),
    "correlation_long": f"WITH {PANEL}, f AS (SELECT *, 1.5::DOUBLE AS constant, NULL::DOUBLE AS unknown FROM ({raw_features_sql()})) SELECT p.a AS a, p.b AS b, p.r AS r FROM (SELECT unnest(["
    + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN round(corr({a}, {b}), 6) + 0.0 END}}" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :])
    + "]) AS p FROM f)",
    "archetype_stats": f"""WITH {PANEL}, c AS (SELECT consumer_id, archetype, avg({E}) AS mean, stddev_samp({E}) / nullif(avg({E}), 0) AS cv, max({E}) AS max, min({E}) AS min FROM panel GROUP BY ALL) """
    + rounded_sql(
        "SELECT archetype, avg(mean) AS avg_mean, stddev_samp(mean) AS std_mean, avg(cv) AS avg_cv, stddev_samp(cv) AS std_cv, avg(max) AS avg_max, avg(min) AS avg_min FROM c GROUP BY archetype",
        ["avg_mean", "std_mean", "avg_cv", "std_cv", "avg_max", "avg_min"],
    ),
    "archetype_hour_profile": f"WITH {PANEL} SELECT archetype, hour, round(avg({E}), 6) + 0.0 AS mean_kwh FROM panel GROUP BY ALL",
    "archetype_variation": f"""WITH {PANEL}, f AS (SELECT DISTINCT consumer_id, archetype FROM panel), k AS (SELECT consumer_id FROM f QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY consumer_id) <= 10)
        SELECT consumer_id, archetype, hour, round(avg({E}), 6) + 0.0 AS mean_kwh FROM panel WHERE consumer_id IN (SELECT consumer_id FROM k) GROUP BY ALL""",
    "first_consumers": f"""WITH {PANEL}, f AS (SELECT DISTINCT consumer_id, archetype FROM panel),
        r AS (SELECT archetype, consumer_id, CAST(row_number() OVER (PARTITION BY archetype ORDER BY consumer_id) AS INTEGER) AS place FROM f) SELECT * FROM r WHERE place <= 10""",
    "dataset_overview": f"""WITH {PANEL}, {GAPPY} SELECT count(DISTINCT consumer_id) AS consumers, count(*) AS rows, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_time,
        strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_time, count(*) FILTER ({E} IS NULL) AS missing FROM gappy""",
    "histogram30": f"""WITH {PANEL}, b AS (SELECT min({E}) AS lo, max({E}) AS hi FROM panel)
        SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) + 0.0 AS low, round(lo + bin * ((hi - lo) / 30), 6) + 0.0 AS high, count(*) AS n FROM (SELECT {_bins(E)} AS bin, lo, hi FROM panel, b) GROUP BY bin, lo, hi""",
    "histogram30_price": f"""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
        SELECT {_bins('l_extendedprice')} AS bin, count(*) AS n FROM lineitem, b GROUP BY ALL""",
    "box_stats_hour": _box_sql("hour"),
    "box_stats_day": _box_sql("day_of_week"),
    "box_stats_weekend": _box_sql("is_weekend"),
    "attach_archetype": f"""WITH {PANEL}, h AS (SELECT DISTINCT consumer_id, hour FROM panel), a AS (SELECT DISTINCT consumer_id, archetype FROM panel)
        SELECT archetype, count(*) AS n FROM h JOIN a USING (consumer_id) GROUP BY archetype""",
    "archetype_templates": _templates_sql(),
    "generated_panel": """WITH n AS (SELECT count(*) AS n FROM supplier)
        SELECT archetype, c AS consumers, c * 336 AS rows, true AS above_floor, CAST(336 AS BIGINT) AS times
        FROM (SELECT unnest(['daytime', 'evening', 'flat', 'weekend']) AS archetype, unnest([n // 4, n // 4, n // 4, n - 3 * (n // 4)]) AS c FROM n) WHERE c > 0""",
}
