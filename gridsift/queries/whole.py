"""Queries whose results SQL can state although they run what SQL cannot: components of two features,
clusters that lie apart, analyses of a panel of two kinds of consumers, artifacts that are read back.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.functions.calendar import with_calendar
from gridsift.operators import cleaning, clustering, exploration, features, metrics, profiling, scaling
from gridsift.operators.pipeline import segmentation
from gridsift.plans import cache, reports
from gridsift.plans.analysis import Analysis, Settings, ablate, analyse, cached, load_components, load_kmeans, load_labels, load_metadata, views
from gridsift.queries.clusters import _CH, _DB, _INSIGHTS, _NAME, _PROFILES, _SILHOUETTE, _X, _behavior, _points, _profiles
from gridsift.queries.clusters import ORACLES as _CLUSTERS
from gridsift.queries import tables as _tables
from gridsift.queries.common import PANEL, panel, raw_features_sql, rounded, rounded_sql, table
from gridsift.schema import ARCHETYPE, BEHAVIORAL, KEY, SCALE, TIME, VALUE, numeric_columns
from gridsift.sources.generator import legacy_panel, perturbed, rolled, season, sinusoid_panel, synthetic_panel
from gridsift.sources.tables import read_csv, read_csv_checked, scratch, write_csv

E = VALUE
_PAIR = ["peak_to_avg_ratio", "coefficient_of_variation"]
_THRESHOLDS = [0.3, 0.6, 0.9, 0.99, 1.5]
_OWN_SCALE = [s for s in SCALE if s.startswith(VALUE)]


# Components of two standardised features: the ratios are (1 + r) / 2 and (1 - r) / 2, and the first one is their sum over the square root of 2.
def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, scaling.Components]:
    rows = _behavior(spark, d).select(KEY, *_PAIR)
    return rows, scaling.fit_components(rows)


def pca_pair_explained(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pair(spark, d)[1].explained(spark))


def pca_components_for_threshold(spark: SparkSession, d: str) -> DataFrame:
    ratios = list(_pair(spark, d)[1].ratios)
    return spark.createDataFrame([(t, scaling.components_needed(ratios, t)) for t in _THRESHOLDS], "threshold double, components int")


def pca_pair_loadings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pair(spark, d)[1].loadings(spark, first=1))


def pca_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _pair(spark, d)
    return rounded(found.scores(rows).select(KEY, F.get("pc", F.lit(0)).alias("pc1")), 5)


def pca_pair_projection(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _pair(spark, d)
    return rounded(scaling.projection(found.scores(rows), first=1))


def pca_identities(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the components of all features, whatever they are."""
    rows = features.consumer_features(panel(spark, d))
    found = scaling.fit_components(rows)
    kept = found.scores(rows)
    ratio = found.ratios
    wide = kept.agg(*(F.var_pop(F.get("pc", F.lit(i))).alias(f"v{i}") for i in range(found.n)), *(F.covar_pop(F.get("pc", F.lit(i)), F.get("pc", F.lit(i + 1))).alias(f"c{i}") for i in range(found.n - 1))).first()
    total = len(found.scaler.columns)  # every standardised column has variance 1
    named = [
        ("ratios sum to one", abs(sum(ratio) - 1) < 1e-9),
        ("ratios do not grow", all(a >= b - 1e-12 for a, b in zip(ratio, ratio[1:], strict=False))),
        ("scores have the variance of their component", all(abs(wide[f"v{i}"] - ratio[i] * total) < 1e-6 for i in range(found.n))),
        ("scores are uncorrelated", all(abs(wide[f"c{i}"]) < 1e-6 for i in range(found.n - 1))),
        ("threshold is reached", sum(ratio[: found.n]) >= scaling.THRESHOLD > sum(ratio[: found.n - 1])),
    ]
    return spark.createDataFrame([(n, bool(h)) for n, h in named], "identity string, holds boolean")


# Four groups of customers that lie apart: the best clusters for K = 2, 3 and 4 are known.
_BASES = {0: 0.0, 1: 8.0, 2: 100.0, 3: 103.0}


def _apart(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(*(F.lit(v) for kv in _BASES.items() for v in kv))[F.col("c_nationkey") % 4]
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias(KEY), F.array(base, F.col("c_acctbal") / 10000).alias("pc"))
    return rows.persist()


def kmeans_apart(spark: SparkSession, d: str) -> DataFrame:
    rows = _apart(spark, d)
    labels = clustering.label(rows, clustering.fit_kmeans(rows, 4)).select(KEY, "cluster")
    first = labels.groupBy("cluster").agg(F.min(KEY).alias("first_of_cluster"), F.count(F.lit(1)).alias("size"))
    return labels.join(first, "cluster").select(KEY, "first_of_cluster", "size")


def k_sweep_apart(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.sweep(_apart(spark, d), range(2, 5))[0], 3)


def stability_apart(spark: SparkSession, d: str) -> DataFrame:
    ari, inertia = clustering.stability(_apart(spark, d), 4, restarts=clustering.RESTARTS)
    return rounded(spark.createDataFrame([clustering.stability_summary(ari, inertia, 4)]).select("k", "n_runs", "mean_ari", "std_ari", "mean_inertia", "std_inertia"), 3)


def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.all_metrics(_points(spark, d))
    names = ["inertia", "silhouette", "ch", "db"]
    return rounded(spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names)), 4)


def silhouette_by_coreset(spark: SparkSession, d: str) -> DataFrame:
    """At the default error a cluster of some thousand points is taken whole, so the values are exact here."""
    return rounded(metrics.silhouettes_by_coreset(_points(spark, d)))


def silhouette_error(spark: SparkSession, d: str) -> DataFrame:
    """Means over all points, exact and from few draws; a mean distance may be off by ``error`` of itself, so a silhouette by twice that."""
    points = _points(spark, d).select("id", F.pmod("cluster", F.lit(2)).alias("cluster"), "x").persist()
    exact, rows = metrics.silhouette(points), []
    for error in (1.0, 0.6):
        kept = metrics.coresets(points, metrics.coreset_size(error))
        rows.append((error, len(kept[0]) < sum(kept[3].values()), round(exact, 4) + 0.0, abs(metrics.silhouette(points, error=error) - exact) <= 2 * error))
    points.unpersist()
    return spark.createDataFrame(rows, "error double, drawn boolean, exact double, within boolean")


def _labelings(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the labelings ``label % k`` of the embeddings, in the form of a sweep."""
    ks = range(2, 6)
    rows = _points(spark, d).select("id", F.array(*(F.pmod("cluster", F.lit(k)) for k in ks)).alias("clusters"), "x")
    found = metrics.metrics_of_labelings(rows, len(ks))
    return spark.createDataFrame([(k, *(m[n] for n in ("inertia", "silhouette", "ch", "db"))) for k, m in zip(ks, found, strict=True)], "k int, inertia double, silhouette double, ch double, db double")


def sweep_of_labelings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_labelings(spark, d), 4)


def k_vote_of_labelings(spark: SparkSession, d: str) -> DataFrame:
    found = _labelings(spark, d)
    return clustering.votes(found).select("k", "votes", F.col("place").cast("int").alias("place"), (F.col("k") == clustering.choose_k(found)).alias("chosen"))


def k_vote(spark: SparkSession, d: str) -> DataFrame:
    return clustering.votes(_labelings(spark, d)).select("k", "votes", F.col("place").cast("int").alias("place"))


def k_chosen(spark: SparkSession, d: str) -> DataFrame:
    found = _labelings(spark, d)
    return spark.createDataFrame([("vote", clustering.choose_k(found)), ("elbow", clustering.choose_k_by_elbow(found))], "rule string, k int")


# Suppliers as consumers of two kinds, hourly over a week: K = 2, one cluster for each kind.
def _two_kinds(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "supplier").select(F.col("s_suppkey").alias(KEY)).crossJoin(F.broadcast(spark.range(168).select(F.col("id").cast("int").alias("at"))))
    hour, day = F.col("at") % 24, F.floor(F.col("at") / 24).cast("int")
    use = F.when(F.col(KEY) % 2 == 0, F.when((hour >= 9) & (hour < 17), 3.0).otherwise(1.0)).otherwise(F.when(hour >= 18, 3.5).otherwise(0.5))
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return grid.select(KEY, (start + F.make_dt_interval(day, hour)).alias(TIME), (use + 0.01 * F.pmod(F.col(KEY) * 31 + hour * 17 + day * 7, F.lit(11))).alias(VALUE))


#: Two kinds lie so far apart that one start finds them; the tries of stability are the usual ten.
_TWO = Settings(ks=(2, 4), restarts=1, name="two kinds")


def _two_analysed(spark: SparkSession, d: str, output: str | None = None, *, stable: bool = False) -> Analysis:
    return analyse(spark, Settings(**(vars(_TWO) | {"output": output, "test_stability": stable})), _two_kinds(spark, d), [TIME])


def analysis_of_two_kinds(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["size", "size_percentage", "avg_consumption", "avg_cv", "avg_peak_to_avg", "weekend_ratio", "cluster_name"]
    return rounded(_two_analysed(spark, d).profiles.select(*wanted))


def analysis_summary(spark: SparkSession, d: str) -> DataFrame:
    found = _two_analysed(spark, d, stable=True)
    own, known = found.summary(), found.metadata()
    refused = False
    try:
        found.silhouette_for(99)
    except KeyError:
        refused = True
    row = (own["k"], min(own["cluster_sizes"]), max(own["cluster_sizes"]), own["feature_set"], known["n_consumers"], known["n_days"], known["data_source"], refused, round(found.stability["mean_ari"], 6))
    return spark.createDataFrame([row], "k int, smallest long, largest long, feature_set string, n_consumers long, n_days long, data_source string, refused boolean, mean_ari double")


def ablation_of_two_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = ablate(spark, _TWO, _two_kinds(spark, d), [TIME])
    return found.select("feature_set", "k", F.array_min("sizes").alias("smallest"), F.array_max("sizes").alias("largest"), F.round("balance", 6).alias("balance"), F.round("mean_ari", 6).alias("mean_ari"))


def analysis_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of what an analysis writes, read back, and of the tables of its dashboard."""
    folder = scratch(spark, "analysis")
    found = _two_analysed(spark, d, folder, stable=True)
    tables = ["metrics/clustering", "metrics/evaluation", "metrics/stability", "reports/cluster_profiles", "reports/cluster_insights"]
    rows = [(name, spark.read.option("header", True).csv(f"{folder}/{name}").count()) for name in tables]
    rows += [("models/labels", load_labels(spark, folder).count()), ("reports/statistical_summary", spark.read.option("header", True).csv(f"{folder}/reports/statistical_summary").count())]
    shown = views(found)
    rows += [(f"view {name}", shown[name].count()) for name in ("overview", "hourly", "weekend", "projection", "metrics", "profiles", "insights")]
    return spark.createDataFrame(rows, "artifact string, rows long")


def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "analysis")
    _two_analysed(spark, d, folder)
    known = load_metadata(spark, folder)
    wanted = ["data_source", "features", "feature_set", "components", "variance", "k", "seed", "versions", "written_at", "name", "fingerprint", "n_consumers", "n_days", "cluster_sizes"]
    rows = [(c, known.get(c) is not None) for c in wanted] + [(f"version of {c}", bool(known["versions"].get(c))) for c in ("pyspark", "java", "python")]
    return spark.createDataFrame(rows, "key string, known boolean")


def models_reloaded(spark: SparkSession, d: str) -> DataFrame:
    """Consumers whose cluster by the reloaded scaler, components and K-Means is the saved one."""
    folder = scratch(spark, "analysis")
    found = _two_analysed(spark, d, folder)
    scores = load_components(spark, folder).scores(found.features)
    again = clustering.label(scores, load_kmeans(spark, folder)).select(KEY, F.col("cluster").alias("again"))
    both = load_labels(spark, folder).join(again, KEY)
    return both.agg(F.count(F.lit(1)).alias("consumers"), F.count_if(F.col("again") == F.col("cluster")).alias("same"))


def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """The same analysis twice, then one of other values under the same settings."""
    folder, rows = scratch(spark, "cache"), []
    one = Settings(**(vars(_TWO) | {"ks": (2, 3), "restarts": 1, "test_stability": False}))
    kinds = _two_kinds(spark, d)
    for turn, panel_now in enumerate([kinds, kinds.repartition(3), kinds.withColumn(VALUE, F.col(VALUE) * 100)]):
        found, made = cached(spark, one, folder, panel_now, [TIME])
        mean = found["profiles"].agg(F.sum(F.col("avg_consumption") * F.col("size")) / F.sum("size")).first()[0]
        rows.append((turn, made, found["projection"].count(), mean))
    return rounded(spark.createDataFrame(rows, "turn int, made boolean, consumers long, mean double"))


def cache_turns(spark: SparkSession, d: str) -> DataFrame:
    """A table kept by content: what makes it anew, and what broken and double writes leave."""
    folder, out = scratch(spark, "cache"), []
    rows = panel(spark, d)
    made_of = lambda df: cache.kept(spark, folder, ["hourly", cache.content_fingerprint(df)], lambda: ({"hourly": exploration.hourly_profile(df)}, lambda: None))
    twice = rows.union(rows.where(F.col("event_id") % 7 == 0))
    changed = rows.withColumn(VALUE, F.when(F.col("event_id") % 7 == 0, F.col(VALUE) + 1).otherwise(F.col(VALUE)))
    for name, df in [("first", rows), ("again", rows), ("in another order", rows.repartition(3)), ("rows repeated", twice), ("values changed", changed), ("repeated again", twice)]:
        tables, made = made_of(df)
        out.append((name, made, tables["hourly"].agg(F.sum("mean_kwh")).first()[0]))
    store = cache.Store(spark, f"{folder}/broken")
    rows.write.parquet(f"{folder}/broken/runs/half/hourly")
    out.append(("a broken write", store.committed() is None, None))
    store.write({"hourly": exploration.hourly_profile(rows)})
    store.write({"hourly": exploration.hourly_profile(rows)})
    out.append(("two writers", len(store.read(store.committed())) == 1, store.read(store.committed())["hourly"].agg(F.sum("mean_kwh")).first()[0]))
    return rounded(spark.createDataFrame(out, "turn string, made boolean, total double"), 4)


def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Which changes of a panel its fingerprint tells."""
    rows = panel(spark, d)
    base = cache.content_fingerprint(rows)
    first = rows.agg(F.min("event_id")).first()[0]
    one = F.col("event_id") == first
    changed = {
        "order and partitions": rows.repartition(3).orderBy(F.desc("event_id")),
        "order of columns": rows.select(*reversed(rows.columns)),
        "one value": rows.withColumn(VALUE, F.when(one, F.col(VALUE) + 1e-9).otherwise(F.col(VALUE))),
        "one value missing": rows.withColumn(VALUE, F.when(~one, F.col(VALUE))),
        "one row less": rows.where(~one),
        "one row twice": rows.union(rows.where(one)),
        "one row thrice": rows.union(rows.where(one)).union(rows.where(one)),
        "a name": rows.withColumnRenamed(VALUE, "kwh"),
        "a type": rows.withColumn("hour", F.col("hour").cast("long")),
    }
    return spark.createDataFrame([(name, cache.content_fingerprint(df) != base) for name, df in changed.items()], "change string, told boolean")


def pipeline_reloaded(spark: SparkSession, d: str) -> DataFrame:
    """A segmentation fitted on the events before July, saved and loaded, labels a panel of all events as the live one does."""
    rows = panel(spark, d)
    live = segmentation(ks=(3, 3), restarts=2).fit(rows.where(F.month(TIME) < 7))
    folder = scratch(spark, "pipeline")
    live.write().overwrite().save(folder)
    loaded = PipelineModel.load(folder)
    other = rows.withColumn(VALUE, F.col(VALUE) * 2)
    both = live.transform(other).select(KEY, "cluster", "pc").join(loaded.transform(other).select(KEY, F.col("cluster").alias("again"), F.col("pc").alias("pc_again")), KEY)
    return both.select(KEY, (F.col("cluster") == F.col("again")).alias("same"), (F.col("pc") == F.col("pc_again")).alias("same_scores"), F.col("cluster").between(0, 2).alias("known"))


def recommendation_report(spark: SparkSession, d: str) -> DataFrame:
    text = reports.recommendation_report(profiling.recommendations(profiling.named_profiles(_profiles(spark, d))))
    return spark.createDataFrame([(line,) for line in text.split("\n") if line], "line string")


def cluster_insights_older(spark: SparkSession, d: str) -> DataFrame:
    return profiling.cluster_insights(_profiles(spark, d), older=True)


# Sources, settings, projections.
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    rows = panel(spark, d).select("event_id", KEY, TIME, VALUE, ARCHETYPE)
    folder = scratch(spark, "csv")
    write_csv(rows, folder, files=None)
    schema = T.StructType([rows.schema[c] for c in rows.columns])
    return read_csv(spark, folder, schema).select("event_id", KEY, F.date_format(TIME, "yyyy-MM-dd HH:mm:ss").alias("at"), VALUE, ARCHETYPE)


def csv_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the events, some with a word for a number, a field too few or too many, read without a schema."""
    rows = panel(spark, d).select("event_id", KEY, F.date_format(TIME, "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(F.col("event_id") % 50 == 7, F.lit("many")).otherwise(F.col(VALUE).cast("string")).alias(VALUE), ARCHETYPE)
    names = rows.columns
    line = F.concat_ws(",", *names)
    short = F.concat_ws(",", *names[:-1])
    line = F.when(F.col("event_id") % 50 == 11, short).when(F.col("event_id") % 50 == 13, F.concat(line, F.lit(",more"))).otherwise(line)
    folder = scratch(spark, "lines")
    rows.select(line.alias("value")).write.text(folder)
    good, rejected = read_csv_checked(spark, folder, names=names, tolerance=0.05)
    kinds = ",".join(t for _, t in good.dtypes)
    found = good.agg(F.lit("kept").alias("lines"), F.count(F.lit(1)).alias("n"), F.round(F.sum(VALUE), 4).alias("total"))
    word = F.when(F.col("line").contains(",many,"), "a word").when(F.col("line").endswith(",more"), "too many").otherwise("too few")
    return found.union(rejected.groupBy(word).agg(F.count(F.lit(1)), F.lit(None).cast("double"))).withColumn("types", F.lit(kinds))


def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Types of a table that was written as CSV, and its sums when it is read again."""
    folder = scratch(spark, "csv")
    write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate")), folder, files=None)
    good, rejected = read_csv_checked(spark, folder)
    sums = good.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("prices"), F.count_distinct("o_orderdate").alias("days"))
    return sums.withColumns({"types": F.lit(",".join(t for _, t in good.dtypes)), "rejected": F.lit(rejected.count())})


def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "csv")
    write_csv(exploration.archetype_statistics(panel(spark, d)), folder)
    back = spark.read.option("header", True).option("inferSchema", True).csv(folder)
    return rounded(back.select(ARCHETYPE, "avg_mean", "avg_cv", "avg_max"))


def _day_shapes(spark: SparkSession, d: str) -> DataFrame:
    """(archetype, shape): the 24 hourly shares of each kind of event."""
    means = [F.coalesce(F.avg(F.when(F.col("hour") == h, F.col(VALUE))), F.lit(0.0)) for h in range(24)]
    days = panel(spark, d).groupBy(ARCHETYPE).agg(F.array(*means).alias("m"))
    return days.select(ARCHETYPE, F.transform("m", lambda x: x / F.aggregate("m", F.lit(0.0), lambda s, v: s + v)).alias("shape"))


def peak_shift(spark: SparkSession, d: str) -> DataFrame:
    moved = _day_shapes(spark, d).withColumn("later", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    return rounded(moved.select(ARCHETYPE, "later", F.posexplode(rolled(F.col("shape"), F.col("later"))).alias("hour", "share")))


def shape_perturbation(spark: SparkSession, d: str) -> DataFrame:
    noise = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (h % 5 - 2) / 20.0)
    return rounded(_day_shapes(spark, d).select(ARCHETYPE, F.posexplode(perturbed(F.col("shape"), noise)).alias("hour", "share")))


def season_temperature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "events").select("event_id", season(F.col("ts")).alias("temperature")))


def generated_panel_rules(spark: SparkSession, d: str) -> DataFrame:
    """What holds for panels of as many consumers as there are customers, by archetype; the older generator has none."""
    n = table(spark, d, "customer").count()
    rows = synthetic_panel(spark, n, 7)
    current = F.abs(F.col("current_a") * F.col("voltage_v") * F.col("power_factor") - F.col(VALUE) * 1000.0) < 1e-6 * (1 + F.col(VALUE) * 1000.0)
    missing = F.avg(F.col("voltage_v").isNull().cast("double"))
    own = rows.groupBy(ARCHETYPE).agg(
        F.min(F.col("power_factor").between(0.85, 0.98)).alias("power_factor_fits"), F.min(F.coalesce(current, F.lit(True))).alias("current_fits"), missing.between(0.001, 0.03).alias("voltage_gaps_fit"), F.count_distinct(KEY).alias("consumers")
    )
    older = sinusoid_panel(spark, n, 7)
    bounded = older.agg(F.lit("older").alias(ARCHETYPE), F.lit(True).alias("power_factor_fits"), (F.min(VALUE) > 0).alias("current_fits"), missing.between(0.005, 0.05).alias("voltage_gaps_fit"), F.count_distinct(KEY).alias("consumers"))
    return own.union(bounded)


def legacy_wrapper(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").count()
    one, two = legacy_panel(spark, n, 3), synthetic_panel(spark, n, 3)
    return two.exceptAll(one).agg(F.count(F.lit(1)).alias("differing")).withColumn("rows", F.lit(one.count()).cast("long"))


def settings_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    made = {"defaults": Settings(), "other output": Settings(output="x", test_stability=False), "other seed": Settings(seed=7)}
    return spark.createDataFrame([(n, s.fingerprint()) for n, s in made.items()], "name string, fingerprint string")


def settings_defaults(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["n_consumers", "n_days", "hourly", "seed", "feature_set", "variance", "ks", "test_stability", "remove_outliers", "name", "restarts"]
    return spark.createDataFrame([(f, str(getattr(Settings(), f))) for f in wanted], "field string, value string")


def required_columns(spark: SparkSession, d: str) -> DataFrame:
    rows, found = panel(spark, d), []
    for wanted in ([KEY, TIME, VALUE], [KEY, "voltage_v"], ["zone", "current_a", TIME]):
        try:
            cleaning.require_columns(rows, wanted)
            found.append((",".join(wanted), ""))
        except ValueError:
            found.append((",".join(wanted), ",".join(cleaning.missing_columns(rows, wanted))))
    return spark.createDataFrame(found, "required string, missing string")


def _selected(feature_set: str, exclude: tuple[str, ...] = ()):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(features.select_features(features.raw_features(panel(spark, d), "combined").na.fill(0.0), feature_set, exclude))

    return run


def numeric_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    columns = numeric_columns(rows, without=("l_orderkey",))
    wide = rows.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns))
    return rounded(wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in columns)))), 2)


def range_to_null_narrow(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.blank_invalid(panel(spark, d), cleaning.VALID_NARROW).select("event_id", VALUE)


def scale_stats_older(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.raw_features(panel(spark, d), "scale", total=False))


def attach_archetype_rows(spark: SparkSession, d: str) -> DataFrame:
    return exploration.attach_archetype(features.hourly_means(panel(spark, d)).select(KEY, "hour"), panel(spark, d))


def _contents(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, key, measure, value): every number of the tables, each with the columns that its row goes by."""
    out = None
    for name, (df, keys) in tables.items():
        rest = [c for c, t in df.dtypes if c not in keys and t in ("double", "bigint", "int")]
        numbers = F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in rest)))
        rows = df.select(F.lit(name).alias("name"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"), numbers)
        out = rows if out is None else out.union(rows)
    return rounded(out)


def exploration_bundle(spark: SparkSession, d: str) -> DataFrame:
    tables = exploration.explore(panel(spark, d).select(KEY, TIME, VALUE, "hour", "day_of_week", "is_weekend"))
    keys = {"describe": ["column"], "hourly": ["hour"], "weekend": ["is_weekend"], "correlations": ["a", "b"], "variability": [KEY]}
    own = lambda name: keys.get(name) or (["bin"] if name.startswith("histogram") else [name.removeprefix("box_")])
    return _contents({name: (df, own(name)) for name, df in tables.items()})


def panel_validation(spark: SparkSession, d: str) -> DataFrame:
    tables = exploration.validate(panel(spark, d))
    keys = {"overview": [], "consumers": [ARCHETYPE], "statistics": [ARCHETYPE], "profiles": [ARCHETYPE, "hour"], "variation": [KEY, ARCHETYPE, "hour"]}
    lines = reports.validation_report(tables["overview"], tables["statistics"], tables["consumers"]).split("\n")
    told = sum(line.startswith("- ") and " consumers, mean " in line for line in lines)
    report = spark.createDataFrame([(told,)], "lines long")
    return _contents({name: (df, keys[name]) for name, df in tables.items()} | {"report": (report, [])})


QUERIES = {
    "pca_pair_explained": pca_pair_explained,
    "pca_components_for_threshold": pca_components_for_threshold,
    "pca_pair_loadings": pca_pair_loadings,
    "pca_pair_scores": pca_pair_scores,
    "pca_pair_projection": pca_pair_projection,
    "pca_identities": pca_identities,
    "kmeans_apart": kmeans_apart,
    "k_sweep_apart": k_sweep_apart,
    "stability_apart": stability_apart,
    "metric_bundle": metric_bundle,
    "silhouette_by_coreset": silhouette_by_coreset,
    "silhouette_error": silhouette_error,
    "sweep_of_labelings": sweep_of_labelings,
    "k_vote_of_labelings": k_vote_of_labelings,
    "k_vote": k_vote,
    "k_chosen": k_chosen,
    "analysis_of_two_kinds": analysis_of_two_kinds,
    "analysis_summary": analysis_summary,
    "ablation_of_two_kinds": ablation_of_two_kinds,
    "analysis_artifacts": analysis_artifacts,
    "metadata_keys": metadata_keys,
    "models_reloaded": models_reloaded,
    "pipeline_reloaded": pipeline_reloaded,
    "result_cache": result_cache,
    "cache_turns": cache_turns,
    "content_fingerprints": content_fingerprints,
    "recommendation_report": recommendation_report,
    "cluster_insights_older": cluster_insights_older,
    "csv_round_trip": csv_round_trip,
    "csv_sink": csv_sink,
    "csv_quarantine": csv_quarantine,
    "csv_inferred": csv_inferred,
    "peak_shift": peak_shift,
    "shape_perturbation": shape_perturbation,
    "season_temperature": season_temperature,
    "generated_panel_rules": generated_panel_rules,
    "legacy_wrapper": legacy_wrapper,
    "settings_fingerprint": settings_fingerprint,
    "settings_defaults": settings_defaults,
    "required_columns": required_columns,
    "select_behavioral": _selected("behavioral"),
    "select_scale": _selected("scale"),
    "select_all_but": _selected("combined", ("weekend_ratio", "skewness")),
    "numeric_projection": numeric_projection,
    "range_to_null_narrow": range_to_null_narrow,
    "scale_stats_older": scale_stats_older,
    "attach_archetype_rows": attach_archetype_rows,
    "exploration_bundle": exploration_bundle,
    "panel_validation": panel_validation,
}

_F = f"f AS ({raw_features_sql(fill=True, scale=False)})"
_Z = f"""WITH {PANEL}, {_F}, z AS (SELECT consumer_id, (peak_to_avg_ratio - avg(peak_to_avg_ratio) OVER ()) / stddev_pop(peak_to_avg_ratio) OVER () AS a,
    (coefficient_of_variation - avg(coefficient_of_variation) OVER ()) / stddev_pop(coefficient_of_variation) OVER () AS b FROM f), r AS (SELECT corr(a, b) AS r FROM z)"""
_MANY = """e AS (SELECT k, id, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p), c AS (SELECT k, cluster, i, avg(v) AS m FROM e GROUP BY ALL),
    t AS (SELECT k, id, cluster, sum((v - m) * (v - m)) AS d2 FROM e JOIN c USING (k, cluster, i) GROUP BY ALL), n AS (SELECT k, cluster, count(*) AS n FROM p GROUP BY ALL),
    w AS (SELECT k, sum(d2) AS inertia FROM t GROUP BY k), g AS (SELECT k, i, avg(v) AS g FROM e GROUP BY ALL), b AS (SELECT k, sum(n * (m - g) * (m - g)) AS b FROM c JOIN n USING (k, cluster) JOIN g USING (k, i) GROUP BY k),
    q AS (SELECT k, sum(n) AS total, count(*) AS clusters FROM n GROUP BY k), s AS (SELECT k, cluster, avg(sqrt(d2)) AS s FROM t GROUP BY ALL),
    m AS (SELECT a.k AS k, a.cluster AS a, b.cluster AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.k = b.k AND a.i = b.i AND a.cluster != b.cluster GROUP BY ALL),
    r AS (SELECT m.k AS k, a, max((x.s + y.s) / d) AS r FROM m JOIN s x ON x.k = m.k AND x.cluster = a JOIN s y ON y.k = m.k AND y.cluster = b GROUP BY m.k, a), db AS (SELECT k, avg(r) AS db FROM r GROUP BY k),
    far AS (SELECT a.k AS k, a.id AS id, a.cluster AS cluster, b.cluster AS other, sum(list_distance(a.x, b.x)) AS d FROM p a JOIN p b ON a.k = b.k GROUP BY ALL),
    o AS (SELECT far.k AS k, id, far.cluster AS cluster, max(CASE WHEN other = far.cluster THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN other != far.cluster THEN d / n END) AS b
      FROM far JOIN n ON n.k = far.k AND n.cluster = other GROUP BY ALL),
    h AS (SELECT k, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM o GROUP BY k),
    found AS (SELECT CAST(w.k AS INTEGER) AS k, inertia, silhouette, b.b * (total - clusters) / (inertia * (clusters - 1)) AS ch, db FROM w JOIN h USING (k) JOIN b USING (k) JOIN q USING (k) JOIN db USING (k))"""
_FOUR = "four AS (SELECT c_custkey AS id, c_nationkey % 4 AS g, [" + "CASE c_nationkey % 4 " + " ".join(f"WHEN {g} THEN CAST({v} AS DOUBLE)" for g, v in _BASES.items()) + " END, CAST(c_acctbal / 10000 AS DOUBLE)] AS x FROM customer)"
_FOUR_P = f"{_FOUR}, p AS (SELECT k, id, CASE WHEN k = 2 THEN g // 2 WHEN k = 3 THEN least(g, 2) ELSE g END AS cluster, x FROM four, (VALUES (2), (3), (4)) v(k))"
_MOD_P = "p AS (SELECT k, vec_id AS id, ((label % k) + k) % k AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings, (VALUES (2), (3), (4), (5)) v(k) WHERE embedding IS NOT NULL AND label IS NOT NULL)"
_VOTES = """l AS (SELECT k, row_number() OVER (ORDER BY silhouette DESC, k) AS r, 0 AS o FROM found UNION ALL SELECT k, row_number() OVER (ORDER BY ch DESC, k), 3 FROM found
    UNION ALL SELECT k, row_number() OVER (ORDER BY db, k), 6 FROM found), v AS (SELECT k, count(*) AS votes, CAST(min(r + o) AS INTEGER) AS place FROM l WHERE r <= 3 GROUP BY k)"""
_MEASURES = ["inertia", "silhouette", "ch", "db"]
_KINDS = f"""kinds AS (SELECT s_suppkey AS consumer_id, CAST(tick % 24 AS INTEGER) AS hour, tick // 24 >= 5 AS is_weekend,
      CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN tick % 24 >= 9 AND tick % 24 < 17 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END ELSE CASE WHEN tick % 24 >= 18 THEN 3.5::DOUBLE ELSE 0.5::DOUBLE END END
        + 0.01::DOUBLE * ((s_suppkey * 31 + tick % 24 * 17 + tick // 24 * 7) % 11) AS {E} FROM supplier, range(168) r(tick)),
    f AS ({raw_features_sql("kinds", fill=True)}),
    pr AS (SELECT count(*) AS size, 100.0 * count(*) / sum(count(*)) OVER () AS size_percentage, avg({E}_mean) AS avg_consumption, avg(coefficient_of_variation) AS avg_cv, avg(peak_to_avg_ratio) AS avg_peak_to_avg,
      avg(weekend_ratio) AS weekend_ratio, avg(morning_usage) AS morning_usage, avg(afternoon_usage) AS afternoon_usage, avg(evening_usage) AS evening_usage, avg(night_usage) AS night_usage FROM f GROUP BY consumer_id % 2)"""
_HALVES = "(SELECT min(n) AS smallest, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM supplier GROUP BY s_suppkey % 2))"
_SHARES = f"""{PANEL}, m AS (SELECT archetype, [{", ".join(f"coalesce(avg({E}) FILTER (hour = {h}), 0)" for h in range(24))}] AS m FROM panel GROUP BY archetype),
    days AS (SELECT archetype, CAST(unnest(range(24)) AS INTEGER) AS hour, unnest(m) / list_sum(m) AS share FROM m)"""


def _count_rows(pairs: list[tuple[str, str]], name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS {name}, CAST({n} AS BIGINT) AS rows" for label, n in pairs)


def _contents_sql(parts: list[tuple[str, str, list[str], list[str]]]) -> str:
    """(name, key, measure, value) of tables that are given as SQL, by the columns that their rows go by."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, concat_ws('/', {', '.join(f'CAST("{k}" AS VARCHAR)' for k in keys) or repr('')}) AS key, unnest([{', '.join(map(repr, measures))}]) AS measure, unnest([{', '.join(f'CAST("{m}" AS DOUBLE)' for m in measures)}]) AS value FROM ({sql})"
        for name, sql, keys, measures in parts
    )


_EXPLORED = [E, "hour", "day_of_week"]


def _fingerprint_sql(name: str, seed: int) -> str:
    text = (
        '{"feature_set": "behavioral", "hourly": true, "kmeans_seed": 42, "ks": [2, 11], "n_consumers": 200, "n_days": 30, "name": "behavioral_primary", '
        f'"remove_outliers": false, "restarts": 10, "seed": {seed}, "variance": 0.95}}'
    )
    return f"SELECT '{name}' AS name, substr(sha256('{text}'), 1, 16) AS fingerprint"


_OLDER = (
    _INSIGHTS.replace("weekend_ratio > 1.15 THEN 'and weekend-oriented energy intensity' WHEN weekend_ratio < 0.85 THEN 'and weekday-oriented energy intensity'", "weekend_ratio > 0.6 THEN 'and higher weekend activity' WHEN weekend_ratio < 0.4 THEN 'and higher weekday activity'")
    .replace("avg_consumption > 2 THEN", "avg_consumption > 1.5 THEN")
    .replace("avg_cv > 0.6", "avg_cv > 0.5")
    .replace("avg_peak_to_avg > 2.5", "avg_peak_to_avg > 2")
    .replace("evening_usage > morning_usage * 1.5 AND", "evening_usage > morning_usage AND")
    .replace(
        "CASE WHEN weekend_ratio > 1.2 THEN 'Weekend-dominant usage: Consider time-of-use optimization' WHEN weekend_ratio < 0.8 THEN 'Weekday-dominant usage: Consider weekend load shifting' END",
        "'Install smart meters for real-time consumption monitoring; Set up automated alerts for unusual consumption patterns; Consider renewable energy integration where feasible'",
    )
)
_ALL = [*BEHAVIORAL, *_OWN_SCALE]
_LINE_SUMS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _features_sql(names: list[str]) -> str:
    return f"WITH {PANEL} " + rounded_sql(f"SELECT consumer_id, {', '.join(names)} FROM ({raw_features_sql(fill=True)})", names)


ORACLES = {
    "pca_pair_explained": f"""{_Z} SELECT component, round(ratio, 6) + 0.0 AS ratio, round(cumulative, 6) + 0.0 AS cumulative, component = 1 OR (1 + abs(r)) / 2 < 0.95 AS chosen FROM (
        SELECT 1 AS component, (1 + abs(r)) / 2 AS ratio, (1 + abs(r)) / 2 AS cumulative, r FROM r UNION ALL SELECT 2, (1 - abs(r)) / 2, 1.0, r FROM r)""",
    "pca_components_for_threshold": f"{_Z} SELECT CAST(t AS DOUBLE) AS threshold, CASE WHEN (1 + abs(r)) / 2 >= t THEN 1 ELSE 2 END AS components FROM r, (VALUES {', '.join(f'({t})' for t in _THRESHOLDS)}) v(t)",
    "pca_pair_loadings": f"SELECT 1 AS component, feature, round(sqrt(0.5), 6) + 0.0 AS loading FROM (VALUES ('{_PAIR[0]}'), ('{_PAIR[1]}')) v(feature)",
    "pca_pair_scores": f"{_Z} SELECT consumer_id, round((a + b) / sqrt(2), 5) + 0.0 AS pc1 FROM z",
    "pca_pair_projection": f"{_Z} SELECT 1 AS component, round(var_pop((a + b) / sqrt(2)), 6) + 0.0 AS variance FROM z",
    "pca_identities": "SELECT * FROM (VALUES ('ratios sum to one', true), ('ratios do not grow', true), ('scores have the variance of their component', true), ('scores are uncorrelated', true), ('threshold is reached', true)) v(identity, holds)",
    "kmeans_apart": "SELECT c_custkey AS consumer_id, min(c_custkey) OVER (PARTITION BY c_nationkey % 4) AS first_of_cluster, count(*) OVER (PARTITION BY c_nationkey % 4) AS size FROM customer",
    "k_sweep_apart": f"WITH {_FOUR_P}, {_MANY} " + rounded_sql("SELECT * FROM found", _MEASURES, 3),
    "stability_apart": f"""WITH {_FOUR}, p AS (SELECT 4 AS k, id, g AS cluster, x FROM four), {_MANY}
        SELECT CAST(4 AS BIGINT) AS k, CAST(10 AS BIGINT) AS n_runs, 1.0::DOUBLE AS mean_ari, 0.0::DOUBLE AS std_ari, round(inertia, 3) + 0.0 AS mean_inertia, 0.0::DOUBLE AS std_inertia FROM found""",
    "metric_bundle": f"""SELECT (SELECT round(inertia, 4) FROM ({_CLUSTERS["inertia_by_label"]})) + 0.0 AS inertia, (SELECT round(avg(silhouette), 4) FROM ({_SILHOUETTE})) + 0.0 AS silhouette,
        (SELECT round(ch, 4) FROM ({_CH})) + 0.0 AS ch, (SELECT round(db, 4) FROM ({_DB})) + 0.0 AS db""",
    "silhouette_by_coreset": _SILHOUETTE,
    "silhouette_error": f"""SELECT error, true AS drawn, exact, true AS within FROM (VALUES (1.0::DOUBLE), (0.6::DOUBLE)) v(error),
        (SELECT round(avg(silhouette), 4) + 0.0 AS exact FROM ({_SILHOUETTE.replace("label AS cluster", "((label % 2) + 2) % 2 AS cluster")}))""",
    "sweep_of_labelings": f"WITH {_MOD_P}, {_MANY} " + rounded_sql("SELECT * FROM found", _MEASURES, 4),
    "k_vote_of_labelings": f"WITH {_MOD_P}, {_MANY}, {_VOTES} SELECT *, k = (SELECT k FROM v ORDER BY votes DESC, place LIMIT 1) AS chosen FROM v",
    "k_vote": f"WITH {_MOD_P}, {_MANY}, {_VOTES} SELECT * FROM v",
    "k_chosen": f"""WITH {_MOD_P}, {_MANY}, {_VOTES}, d AS (SELECT k, silhouette, lag(inertia) OVER (ORDER BY k) - 2 * inertia + lead(inertia) OVER (ORDER BY k) AS bend FROM found),
        best AS (SELECT k FROM d WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1), top AS (SELECT k FROM found ORDER BY silhouette DESC, k LIMIT 1)
        SELECT 'vote' AS rule, (SELECT k FROM v ORDER BY votes DESC, place LIMIT 1) AS k
        UNION ALL SELECT 'elbow', CAST(CASE WHEN top.k BETWEEN 3 AND 6 THEN top.k WHEN best.k BETWEEN 3 AND 6 THEN best.k ELSE top.k END AS INTEGER) FROM best, top""",
    "analysis_of_two_kinds": f"WITH {_KINDS}, named AS (SELECT *, {_NAME} AS cluster_name FROM (SELECT *, (SELECT quantile_cont(avg_consumption, 0.5) FROM pr) AS pop FROM pr)) "
    + rounded_sql("SELECT size, size_percentage, avg_consumption, avg_cv, avg_peak_to_avg, weekend_ratio, cluster_name FROM named", ["size_percentage", "avg_consumption", "avg_cv", "avg_peak_to_avg", "weekend_ratio"]),
    "analysis_summary": f"SELECT 2 AS k, smallest, largest, 'behavioral' AS feature_set, total AS n_consumers, CAST(7 AS BIGINT) AS n_days, 'given panel' AS data_source, true AS refused, 1.0::DOUBLE AS mean_ari FROM {_HALVES}",
    "ablation_of_two_kinds": f"SELECT feature_set, 2 AS k, smallest, largest, round(smallest / largest, 6) AS balance, 1.0::DOUBLE AS mean_ari FROM {_HALVES}, (VALUES ('behavioral'), ('scale'), ('combined')) v(feature_set)",
    "analysis_artifacts": _count_rows(
        [
            ("metrics/clustering", "2"), ("metrics/evaluation", "1"), ("metrics/stability", "1"), ("reports/cluster_profiles", "2"), ("reports/cluster_insights", "2"),
            ("models/labels", "(SELECT count(*) FROM supplier)"), ("reports/statistical_summary", "4"), ("view overview", "1"), ("view hourly", "24"), ("view weekend", "2"),
            ("view projection", "(SELECT count(*) FROM supplier)"), ("view metrics", "2"), ("view profiles", "2"), ("view insights", "2"),
        ],
        "artifact",
    ),
    "metadata_keys": "SELECT key, true AS known FROM (VALUES " + ", ".join(f"('{k}')" for k in ("data_source features feature_set components variance k seed versions written_at name fingerprint n_consumers n_days cluster_sizes".split())) + ", ('version of pyspark'), ('version of java'), ('version of python')) v(key)",
    "pipeline_reloaded": f"WITH {PANEL} SELECT DISTINCT consumer_id, true AS same, true AS same_scores, true AS known FROM panel WHERE consumer_id IS NOT NULL",
    "models_reloaded": "SELECT count(*) AS consumers, count(*) AS same FROM supplier",
    "result_cache": f"""WITH {_KINDS} SELECT CAST(turn AS INTEGER) AS turn, turn != 1 AS made, (SELECT count(*) FROM supplier) AS consumers, round((SELECT avg({E}_mean) FROM f) * CASE turn WHEN 2 THEN 100 ELSE 1 END, 6) + 0.0 AS mean FROM range(3) r(turn)""",
    "cache_turns": f"""WITH {PANEL}, turns(turn, made, again, more) AS (VALUES ('first', true, 0, 0), ('again', false, 0, 0), ('in another order', false, 0, 0), ('rows repeated', true, 1, 0), ('values changed', true, 0, 1),
          ('repeated again', false, 1, 0), ('two writers', true, 0, 0)),
        h AS (SELECT turn, made, hour, sum(w * ({E} + more * (event_id % 7 = 0)::INTEGER)) / sum(w) AS m FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 1 + again ELSE 1 END AS w FROM panel, turns) WHERE {E} IS NOT NULL GROUP BY ALL)
        SELECT turn, made, round(sum(m), 4) + 0.0 AS total FROM h GROUP BY turn, made UNION ALL SELECT 'a broken write', true, NULL""",
    "content_fingerprints": """SELECT * FROM (VALUES ('order and partitions', false), ('order of columns', false), ('one value', true), ('one value missing', true), ('one row less', true),
        ('one row twice', true), ('one row thrice', true), ('a name', true), ('a type', true)) v(change, told)""",
    "recommendation_report": f"""WITH rec AS ({_CLUSTERS["recommendations"]}) SELECT '# Recommendations' AS line UNION ALL SELECT 'Each one names the measured trait of the cluster that triggers it.'
        UNION ALL SELECT DISTINCT concat('## ', cluster_name, ' (cluster ', cluster, ')') FROM rec UNION ALL SELECT concat(rank, '. **', recommendation, '** [', upper(priority), ', ', category, ']: ', evidence) FROM rec""",
    "cluster_insights_older": f"WITH {_PROFILES} {_OLDER}",
    "csv_round_trip": f"WITH {PANEL} SELECT event_id, consumer_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at, {E}, archetype FROM panel",
    "csv_quarantine": f"""WITH {PANEL}, k AS (SELECT CASE event_id % 50 WHEN 7 THEN 'a word' WHEN 11 THEN 'too few' WHEN 13 THEN 'too many' ELSE 'kept' END AS lines, {E} FROM panel)
        SELECT lines, count(*) AS n, CASE WHEN lines = 'kept' THEN round(sum({E}), 4) END AS total, 'bigint,bigint,timestamp_ntz,double,string' AS types FROM k GROUP BY lines""",
    "csv_inferred": """SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS prices, count(DISTINCT CAST(o_orderdate AS DATE)) AS days,
        'bigint,bigint,string,double,date' AS types, CAST(0 AS BIGINT) AS rejected FROM orders""",
    "csv_sink": f"""WITH {PANEL}, c AS (SELECT consumer_id, archetype, avg({E}) AS mean, stddev_samp({E}) / nullif(avg({E}), 0) AS cv, max({E}) AS max FROM panel GROUP BY ALL) """
    + rounded_sql("SELECT archetype, avg(mean) AS avg_mean, avg(cv) AS avg_cv, avg(max) AS avg_max FROM c GROUP BY archetype", ["avg_mean", "avg_cv", "avg_max"]),
    "peak_shift": f"WITH {_SHARES} SELECT archetype, CAST(later AS INTEGER) AS later, CAST((hour + later + 24) % 24 AS INTEGER) AS hour, round(share, 6) + 0.0 AS share FROM days, range(-3, 4) r(later)",
    "shape_perturbation": f"""WITH {_SHARES}, n AS (SELECT archetype, hour, greatest(share + (hour % 5 - 2) / 20.0::DOUBLE, 0.01) AS v FROM days)
        SELECT archetype, hour, round(v / sum(v) OVER (PARTITION BY archetype), 6) + 0.0 AS share FROM n""",
    "season_temperature": f"SELECT event_id, round(20 + 5 * sin(2 * {math.pi!r} * (hour(ts) - 14) / 24) + 5 * sin(2 * {math.pi!r} * (dayofyear(ts) - 172) / 365), 6) + 0.0 AS temperature FROM events",
    "generated_panel_rules": "SELECT archetype, true AS power_factor_fits, true AS current_fits, true AS voltage_gaps_fit, consumers FROM (SELECT unnest(['daytime', 'evening', 'flat', 'weekend', 'older']) AS archetype, unnest([n // 4, n // 4, n // 4, n - 3 * (n // 4), n]) AS consumers FROM (SELECT count(*) AS n FROM customer))",
    "legacy_wrapper": "SELECT CAST(0 AS BIGINT) AS differing, count(*) * 72 AS rows FROM supplier",
    "settings_fingerprint": " UNION ALL ".join(_fingerprint_sql(n, s) for n, s in (("defaults", 42), ("other output", 42), ("other seed", 7))),
    "settings_defaults": "SELECT * FROM (VALUES ('n_consumers', '200'), ('n_days', '30'), ('hourly', 'True'), ('seed', '42'), ('feature_set', 'behavioral'), ('variance', '0.95'), ('ks', '(2, 11)'), ('test_stability', 'True'), ('remove_outliers', 'False'), ('name', 'behavioral_primary'), ('restarts', '10')) v(field, value)",
    "required_columns": f"SELECT * FROM (VALUES ('{KEY},{TIME},{VALUE}', ''), ('{KEY},voltage_v', 'voltage_v'), ('zone,current_a,{TIME}', 'current_a,zone')) v(required, missing)",
    "select_behavioral": _features_sql(BEHAVIORAL),
    "select_scale": _features_sql(_OWN_SCALE),
    "select_all_but": _features_sql([c for c in _ALL if c not in ("weekend_ratio", "skewness")]),
    "numeric_projection": " UNION ALL ".join(f"SELECT '{c}' AS column, round(sum(CAST({c} AS DOUBLE)), 2) + 0.0 AS total FROM lineitem" for c in _LINE_SUMS),
    "range_to_null_narrow": f"WITH {PANEL} SELECT event_id, CASE WHEN {E} BETWEEN 0 AND 100 THEN {E} END AS {E} FROM panel",
    "scale_stats_older": f"WITH {PANEL} " + rounded_sql(f"SELECT consumer_id, {', '.join(_OWN_SCALE[:-1])} FROM ({raw_features_sql()})", _OWN_SCALE[:-1]),
    "attach_archetype_rows": f"WITH {PANEL}, h AS (SELECT DISTINCT consumer_id, hour FROM panel), a AS (SELECT DISTINCT consumer_id, archetype FROM panel) SELECT consumer_id, hour, archetype FROM h JOIN a USING (consumer_id)",
    "exploration_bundle": _contents_sql([
        ("describe", f"WITH {PANEL} " + _tables._describe("panel", _EXPLORED, 6), ["column"], ["mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]),
        ("hourly", _tables.ORACLES["hourly_profile"], ["hour"], ["mean_kwh"]),
        ("weekend", _tables.ORACLES["weekend_profile"], ["is_weekend"], ["mean_kwh"]),
        ("correlations", f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM panel" for i, a in enumerate(_EXPLORED) for b in _EXPLORED[i + 1 :]), ["a", "b"], ["r"]),
        ("variability", _tables.ORACLES["consumer_cv"], ["consumer_id"], ["mean_kwh", "std_kwh", "cv"]),
        *((f"histogram_{c}", f"""WITH {PANEL}, b AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM panel)
            SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) + 0.0 AS low, round(lo + bin * ((hi - lo) / 30), 6) + 0.0 AS high, count(*) AS n FROM (SELECT {_tables._bins(c)} AS bin, lo, hi FROM panel, b) GROUP BY bin, lo, hi""", ["bin"], ["low", "high", "n"]) for c in _EXPLORED),
        *((f"box_{by}", _tables._box_sql(by), [by], ["q1", "q2", "q3", "low_whisker", "high_whisker", "outliers", "n"]) for by in ("hour", "day_of_week", "is_weekend")),
    ]),
    "panel_validation": _contents_sql([
        ("overview", f"WITH {PANEL} SELECT count(DISTINCT consumer_id) AS consumers, count(*) AS rows, count(*) FILTER ({E} IS NULL) AS missing FROM panel", [], ["consumers", "rows", "missing"]),
        ("consumers", f"WITH {PANEL} SELECT archetype, count(DISTINCT consumer_id) AS consumers, count(*) AS rows FROM panel GROUP BY archetype", ["archetype"], ["consumers", "rows"]),
        ("statistics", _tables.ORACLES["archetype_stats"], ["archetype"], ["avg_mean", "std_mean", "avg_cv", "std_cv", "avg_max", "avg_min"]),
        ("profiles", _tables.ORACLES["archetype_hour_profile"], ["archetype", "hour"], ["mean_kwh"]),
        ("variation", _tables.ORACLES["archetype_variation"], ["consumer_id", "archetype", "hour"], ["mean_kwh"]),
        ("report", f"WITH {PANEL} SELECT count(DISTINCT archetype) AS lines FROM panel", [], ["lines"]),
    ]),
}
assert _X in _CH
