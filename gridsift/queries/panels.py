"""Queries on cleaning and features, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.functions.calendar import parse_time, with_calendar
from gridsift.functions.quantiles import exact_quantiles
from gridsift.functions.stats import kurtosis_g2, ratio, skewness_g1
from gridsift.operators import cleaning, features
from gridsift.queries.common import GAPPY, PANEL, gappy, moment_sql, panel, raw_features_sql, rounded, rounded_sql, table
from gridsift.schema import BEHAVIORAL, KEY, SCALE, SHAPE, TIME, VALUE
from gridsift.sources.tables import as_panel, store_panel

_SCALE = [s for s in SCALE if s.startswith(VALUE)]
_NARROW = {VALUE: (5.0, 120.0)}
E = VALUE


def calendar_extract(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("event_id", "hour", "day_of_week", "is_weekend", "month")


def time_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.col("ts").cast("string")).alias(TIME))
    return with_calendar(parse_time(raw)).select("event_id", F.date_format(TIME, "yyyy-MM-dd HH:mm:ss").alias("at"), "is_weekend")


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).select("event_id", KEY, VALUE, "archetype", "hour")
    return rows.union(rows.where("event_id % 5 = 0"))


def dedup_full_row(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_repeated_rows(_repeated(spark, d))


def range_to_null(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.blank_invalid(panel(spark, d), _NARROW).select("event_id", VALUE)


def invalid_count(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.invalid_counts(panel(spark, d), _NARROW).select(F.col(VALUE).alias("invalid"))


def missing_count(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.missing_count(gappy(spark, d))


def _fill(forward: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return cleaning.fill(gappy(spark, d), [VALUE], forward=forward, order=[TIME, "event_id"]).select("event_id", KEY, VALUE)

    return run


def fill_ungrouped(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.fill_ungrouped(gappy(spark, d), [VALUE], order=[TIME, "event_id"]).select("event_id", VALUE)


def _fill_by_day(forward: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return cleaning.fill_long(gappy(spark, d), [VALUE], forward=forward, order=[TIME, "event_id"]).select("event_id", KEY, VALUE)

    return run


def fill_one_consumer(spark: SparkSession, d: str) -> DataFrame:
    """All rows as one consumer's, most of them missing for weeks."""
    rows = gappy(spark, d).withColumns({KEY: F.lit(1), VALUE: F.when(F.dayofyear(TIME) % 30 == 0, F.col(VALUE))})
    return cleaning.fill_long(rows, [VALUE], order=[TIME, "event_id"]).select("event_id", VALUE)


def clean_long_consumers(spark: SparkSession, d: str) -> DataFrame:
    rows = gappy(spark, d).drop("hour", "day_of_week", "is_weekend", "month")
    rows = rows.union(rows.where("event_id % 5 = 0"))
    return cleaning.clean(rows, ranges=_NARROW, order=[TIME, "event_id"], long_consumers=True).select("event_id", KEY, VALUE, "hour", "day_of_week", "is_weekend", "month")


def mean_impute(spark: SparkSession, d: str) -> DataFrame:
    rows = gappy(spark, d).withColumn(VALUE, F.when(F.col(KEY) % 9 != 0, F.col(VALUE)))
    return rounded(cleaning.fill_mean(rows, [VALUE]).select("event_id", VALUE))


def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.impute(gappy(spark, d), "drop").select("event_id", VALUE)


def outlier_iqr(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.flag_outliers(panel(spark, d), threshold=1.5).select("event_id", "is_outlier")


def outlier_iqr_removed(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.without_outliers(table(spark, d, "lineitem"), "l_extendedprice", threshold=0.5).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def outlier_zscore(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.flag_outliers(panel(spark, d), method="zscore", threshold=2.0).select("event_id", "is_outlier")


def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = gappy(spark, d).drop("hour", "day_of_week", "is_weekend", "month")
    rows = rows.union(rows.where("event_id % 5 = 0"))
    return cleaning.clean(rows, ranges=_NARROW, order=[TIME, "event_id"]).select("event_id", KEY, VALUE, "hour", "day_of_week", "is_weekend", "month")


def hourly_shape_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.hourly_means(panel(spark, d)))


def _columns(names: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(features.raw_features(panel(spark, d), "behavioral").select(KEY, *names))

    return run


def scale_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.raw_features(panel(spark, d), "scale"))


def features_behavioral(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.raw_features(panel(spark, d), "behavioral").na.fill(0.0))


def features_combined(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.raw_features(panel(spark, d), "combined").na.fill(0.0))


def features_of_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning and features in one plan with one exchange."""
    rows = gappy(spark, d).drop("hour", "day_of_week", "is_weekend", "month")
    return rounded(features.raw_features(cleaning.clean(rows, order=[TIME, "event_id"]), "behavioral").na.fill(0.0))


def nonconstant_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = features.raw_features(panel(spark, d).withColumn("hour", F.lit(3)), "behavioral")
    varying = set(features.varying_columns(raw, BEHAVIORAL))
    return spark.createDataFrame([(c, c in varying) for c in BEHAVIORAL], "feature string, varies boolean")


def daily_panel_supplier(spark: SparkSession, d: str) -> DataFrame:
    rows = as_panel(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")
    return rounded(features.raw_features(with_calendar(rows), "combined").na.fill(0.0))


def small_group_guards(spark: SparkSession, d: str) -> DataFrame:
    rows = as_panel(table(spark, d, "orders"), "o_custkey", "o_orderdate", F.col("o_totalprice") / 1000)
    mean, std = F.avg(VALUE), F.stddev_samp(VALUE)
    return rounded(
        rows.groupBy(KEY).agg(F.count(VALUE).alias("n"), ratio(std, mean).alias("cv"), skewness_g1(VALUE).alias("skewness"), kurtosis_g2(VALUE).alias("kurtosis"))
    )


def weekend_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.weekend_share(panel(spark, d)))


def archetype_by_time(spark: SparkSession, d: str) -> DataFrame:
    from gridsift.operators.exploration import attach_archetype_by_time

    rows = panel(spark, d)
    joined = attach_archetype_by_time(rows.drop("archetype"), rows.where("archetype != 'click'").select(KEY, TIME, "archetype"))
    return joined.select("event_id", "archetype")


def archetype_by_day(spark: SparkSession, d: str) -> DataFrame:
    """By consumer and day, so that the archetype's side repeats keys with different archetypes."""
    from gridsift.operators.exploration import attach_archetype_by_time

    days = panel(spark, d).withColumn(TIME, F.date_trunc("day", TIME))
    return attach_archetype_by_time(days.drop("archetype"), days.where("archetype != 'click'")).select("event_id", "archetype")


def features_of_stored(spark: SparkSession, d: str) -> DataFrame:
    """Features of a cleaned panel that was stored by consumer."""
    rows = gappy(spark, d).drop("hour", "day_of_week", "is_weekend", "month")
    stored = store_panel(cleaning.clean(rows, order=[TIME, "event_id"]))
    return rounded(features.raw_features(stored, "behavioral").na.fill(0.0))


def consumer_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of all consumers of a panel in which one consumer holds a third of the rows."""
    rows = panel(spark, d)
    hot = rows.withColumn(KEY, F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col(KEY)))
    return rounded(features.consumer_medians(hot))


def scale_stats_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.raw_features(panel(spark, d), "scale", spread_medians=True))


def quantiles_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the prices of every customer's orders: many small groups."""
    found = exact_quantiles(table(spark, d, "orders"), ["o_totalprice"], [0.25, 0.5, 0.75], ["o_custkey"])
    return rounded(found.select("o_custkey", "probability", "value"))


QUERIES = {
    "calendar_extract": calendar_extract,
    "time_parse": time_parse,
    "dedup_full_row": dedup_full_row,
    "range_to_null": range_to_null,
    "invalid_count": invalid_count,
    "missing_count": missing_count,
    "ffill_bfill": _fill(True),
    "bfill_ffill": _fill(False),
    "ffill_bfill_by_day": _fill_by_day(True),
    "bfill_ffill_by_day": _fill_by_day(False),
    "fill_one_consumer": fill_one_consumer,
    "clean_long_consumers": clean_long_consumers,
    "fill_ungrouped": fill_ungrouped,
    "mean_impute": mean_impute,
    "drop_nulls": drop_nulls,
    "outlier_iqr": outlier_iqr,
    "outlier_iqr_removed": outlier_iqr_removed,
    "outlier_zscore": outlier_zscore,
    "clean_pipeline": clean_pipeline,
    "hourly_shape_long": hourly_shape_long,
    "hourly_shape_wide": _columns(SHAPE),
    "period_usage": _columns(["morning_usage", "afternoon_usage", "evening_usage", "night_usage"]),
    "weekend_ratio": _columns(["weekend_ratio"]),
    "load_variability": _columns(["peak_to_avg_ratio", "coefficient_of_variation", "skewness", "kurtosis"]),
    "scale_stats": scale_stats,
    "features_behavioral": features_behavioral,
    "features_combined": features_combined,
    "features_of_cleaned": features_of_cleaned,
    "nonconstant_columns": nonconstant_columns,
    "daily_panel_supplier": daily_panel_supplier,
    "small_group_guards": small_group_guards,
    "weekend_share": weekend_share,
    "archetype_by_time": archetype_by_time,
    "archetype_by_day": archetype_by_day,
    "features_of_stored": features_of_stored,
    "consumer_medians": consumer_medians,
    "scale_stats_spread": scale_stats_spread,
    "quantiles_of_orders": quantiles_of_orders,
}

_W = "PARTITION BY consumer_id ORDER BY timestamp, event_id"


def _fill_sql(source: str, own: str, forward: bool) -> str:
    back = f"last_value({E} IGNORE NULLS) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"first_value({E} IGNORE NULLS) OVER ({own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    first, second = (back, ahead) if forward else (ahead, back)
    return f"SELECT * REPLACE (coalesce({first}, {second}) AS {E}) FROM {source}"


def _subset(names: list[str]) -> str:
    return f"WITH {PANEL} " + rounded_sql(f"SELECT consumer_id, {', '.join(names)} FROM ({raw_features_sql(scale=False)})", names)


def _varies() -> str:
    rows = f"raw AS ({raw_features_sql('(SELECT * REPLACE (3 AS hour) FROM panel)', scale=False)})"
    return f"WITH {PANEL}, {rows} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(min({c}) < max({c}), false) AS varies FROM raw" for c in BEHAVIORAL)


_LO, _HI = _NARROW[VALUE]
_QUARTILES = "q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"
ORACLES = {
    "calendar_extract": f"WITH {PANEL} SELECT event_id, hour, day_of_week, is_weekend, month FROM panel",
    "time_parse": """
        WITH t AS (SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'no time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS ts FROM events)
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, coalesce(isodow(ts) >= 6, false) AS is_weekend FROM t""",
    "dedup_full_row": f"""WITH {PANEL}, r AS (SELECT event_id, consumer_id, {E}, archetype, hour FROM panel)
        SELECT DISTINCT * FROM (SELECT * FROM r UNION ALL SELECT * FROM r WHERE event_id % 5 = 0)""",
    "range_to_null": f"WITH {PANEL} SELECT event_id, CASE WHEN {E} BETWEEN {_LO} AND {_HI} THEN {E} END AS {E} FROM panel",
    "invalid_count": f"WITH {PANEL} SELECT count(*) FILTER (NOT {E} BETWEEN {_LO} AND {_HI}) AS invalid FROM panel",
    "missing_count": f"WITH {PANEL}, {GAPPY} SELECT count(*) FILTER ({E} IS NULL) AS missing FROM gappy",
    "ffill_bfill": f"WITH {PANEL}, {GAPPY} SELECT event_id, consumer_id, {E} FROM ({_fill_sql('gappy', _W, True)})",
    "bfill_ffill": f"WITH {PANEL}, {GAPPY} SELECT event_id, consumer_id, {E} FROM ({_fill_sql('gappy', _W, False)})",
    "fill_ungrouped": f"WITH {PANEL}, {GAPPY} SELECT event_id, {E} FROM ({_fill_sql('gappy', 'ORDER BY timestamp, event_id', True)})",
    "mean_impute": f"""WITH {PANEL}, {GAPPY}, m AS (SELECT event_id, consumer_id, CASE WHEN consumer_id % 9 != 0 THEN {E} END AS e FROM gappy),
        o AS (SELECT event_id, coalesce(e, avg(e) OVER (PARTITION BY consumer_id)) AS e FROM m)
        SELECT event_id, round(coalesce(e, (SELECT avg(e) FROM o)), 6) + 0.0 AS {E} FROM o""",
    "drop_nulls": f"WITH {PANEL}, {GAPPY} SELECT event_id, {E} FROM gappy WHERE {E} IS NOT NULL",
    "outlier_iqr": f"""WITH {PANEL}, {_QUARTILES.format(c=E, t="panel")}
        SELECT event_id, {E} < a - 1.5 * (b - a) OR {E} > b + 1.5 * (b - a) AS is_outlier FROM panel, q""",
    "outlier_iqr_removed": f"""WITH {_QUARTILES.format(c="l_extendedprice", t="lineitem")}
        SELECT l_returnflag, count(*) AS n FROM lineitem, q
        WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) GROUP BY l_returnflag""",
    "outlier_zscore": f"""WITH {PANEL}, s AS (SELECT avg({E}) AS m, stddev_samp({E}) AS s FROM panel)
        SELECT event_id, abs({E} - m) / s > 2.0 AS is_outlier FROM panel, s""",
    "clean_pipeline": f"""WITH {PANEL}, {GAPPY}, r AS (SELECT DISTINCT * FROM (SELECT * FROM gappy UNION ALL SELECT * FROM gappy WHERE event_id % 5 = 0)),
        v AS (SELECT * REPLACE (CASE WHEN {E} BETWEEN {_LO} AND {_HI} THEN {E} END AS {E}) FROM r)
        SELECT event_id, consumer_id, {E}, hour, day_of_week, is_weekend, month FROM ({_fill_sql('v', _W, True)})""",
    "hourly_shape_long": f"""WITH {PANEL}, h AS (SELECT consumer_id, hour, avg({E}) AS m FROM panel GROUP BY ALL)
        SELECT consumer_id, hour, round(m, 6) + 0.0 AS mean_kwh, round(m / sum(m) OVER (PARTITION BY consumer_id), 6) + 0.0 AS share FROM h""",
    "hourly_shape_wide": _subset(SHAPE),
    "period_usage": _subset(["morning_usage", "afternoon_usage", "evening_usage", "night_usage"]),
    "weekend_ratio": _subset(["weekend_ratio"]),
    "load_variability": _subset(["peak_to_avg_ratio", "coefficient_of_variation", "skewness", "kurtosis"]),
    "scale_stats": f"WITH {PANEL} " + rounded_sql(f"SELECT consumer_id, {', '.join(_SCALE)} FROM ({raw_features_sql()})", _SCALE),
    "features_behavioral": f"WITH {PANEL} " + rounded_sql(raw_features_sql(fill=True, scale=False), BEHAVIORAL),
    "features_combined": f"WITH {PANEL} " + rounded_sql(raw_features_sql(fill=True), [*BEHAVIORAL, *_SCALE]),
    "features_of_cleaned": f"""WITH {PANEL}, {GAPPY}, v AS (SELECT * REPLACE (CASE WHEN {E} BETWEEN 0 AND 1000 THEN {E} END AS {E}) FROM gappy),
        filled AS ({_fill_sql('v', _W, True)}) """ + rounded_sql(raw_features_sql("filled", fill=True, scale=False), BEHAVIORAL),
    "nonconstant_columns": _varies(),
    "daily_panel_supplier": f"""WITH daily AS (SELECT l_suppkey AS consumer_id, l_quantity AS {E}, hour(l_shipdate) AS hour, isodow(l_shipdate) >= 6 AS is_weekend FROM lineitem) """
    + rounded_sql(raw_features_sql("daily", fill=True), [*BEHAVIORAL, *_SCALE]),
    "small_group_guards": rounded_sql(
        f"SELECT consumer_id, count(e) AS n, stddev_samp(e) / nullif(avg(e), 0) AS cv, {moment_sql('skewness', 'e', 3)}, {moment_sql('kurtosis', 'e', 4)} "
        "FROM (SELECT o_custkey AS consumer_id, o_totalprice / 1000 AS e FROM orders) GROUP BY consumer_id",
        ["cv", "skewness", "kurtosis"],
    ),
    "weekend_share": f"WITH {PANEL} SELECT consumer_id, round(avg(CAST(is_weekend AS INTEGER)), 6) + 0.0 AS weekend_share FROM panel GROUP BY consumer_id",
    "consumer_medians": f"WITH {PANEL} SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE consumer_id END AS consumer_id, round(quantile_cont({E}, 0.5), 6) + 0.0 AS {E}_median FROM panel WHERE consumer_id IS NOT NULL OR event_id % 3 = 0 GROUP BY 1 HAVING count({E}) > 0",
    "quantiles_of_orders": "SELECT o_custkey, p AS probability, round(q, 6) + 0.0 AS value FROM (SELECT o_custkey, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS p, unnest(quantile_cont(o_totalprice::DOUBLE, [0.25, 0.5, 0.75])) AS q FROM orders GROUP BY o_custkey)",
    "fill_one_consumer": f"""WITH {PANEL}, {GAPPY}, one AS (SELECT event_id, timestamp, CASE WHEN dayofyear(timestamp) % 30 = 0 THEN {E} END AS {E} FROM gappy)
        SELECT event_id, coalesce(last_value({E} IGNORE NULLS) OVER (ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          first_value({E} IGNORE NULLS) OVER (ORDER BY timestamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {E} FROM one""",
    "archetype_by_day": f"""WITH {PANEL}, a AS (SELECT DISTINCT consumer_id, date_trunc('day', timestamp) AS day, archetype FROM panel WHERE archetype != 'click')
        SELECT p.event_id, a.archetype FROM panel p LEFT JOIN a ON p.consumer_id = a.consumer_id AND date_trunc('day', p.timestamp) = a.day""",
    "archetype_by_time": f"""WITH {PANEL}, a AS (SELECT consumer_id, timestamp, archetype FROM panel WHERE archetype != 'click')
        SELECT p.event_id, a.archetype FROM panel p LEFT JOIN a ON p.consumer_id = a.consumer_id AND p.timestamp = a.timestamp""",
}
ORACLES["scale_stats_spread"] = ORACLES["scale_stats"]
ORACLES |= {"features_of_stored": ORACLES["features_of_cleaned"], "ffill_bfill_by_day": ORACLES["ffill_bfill"], "bfill_ffill_by_day": ORACLES["bfill_ffill"], "clean_long_consumers": ORACLES["clean_pipeline"]}
