"""Synthetic panels of four archetypes of consumers.

Every random number is a hash of the seed and of what it belongs to (a consumer, a day, an hour),
so the panel is the same for any number of partitions, and a row needs nothing of the rows around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.functions.calendar import is_weekend
from gridsift.schema import ARCHETYPE, KEY, TIME, VALUE

#: Level of each hour of the day before normalisation, as (first hour, hour after the last, level).
TEMPLATES = {
    "daytime": [(0, 7, 0.2), (7, 9, 0.5), (9, 17, 1.0), (17, 19, 0.5), (19, 24, 0.3)],
    "evening": [(0, 8, 0.15), (8, 16, 0.4), (16, 18, 0.6), (18, 22, 1.0), (22, 24, 0.4)],
    "flat": [(0, 6, 0.6), (6, 12, 0.8), (12, 14, 0.9), (14, 24, 0.8)],
    "weekend": [(0, 10, 0.4), (10, 20, 0.8), (20, 24, 0.5)],
}
#: Factor on weekend days and on weekdays.
WEEKEND_FACTORS = {"daytime": (0.7, 1.0), "evening": (0.9, 1.0), "flat": (0.9, 1.0), "weekend": (1.3, 0.8)}
SHARES = {"daytime": 0.25, "evening": 0.25, "flat": 0.25, "weekend": 0.25}
START = "2024-01-01"
FLOOR = 0.01
MISSING_VOLTAGE = 0.01


def template(archetype: str) -> list[float]:
    """24 hourly shares that sum to one."""
    if archetype not in TEMPLATES:
        raise ValueError(f"Unknown archetype: {archetype}")
    levels = [level for first, after, level in TEMPLATES[archetype] for _ in range(first, after)]
    return [level / sum(levels) for level in levels]


def templates(spark: SparkSession) -> DataFrame:
    """(archetype, hour, share) of all archetypes: 96 rows."""
    rows = [(a, h, share) for a in TEMPLATES for h, share in enumerate(template(a))]
    return spark.createDataFrame(rows, "archetype string, hour int, share double")


def _uniform(seed: int, what: str, *of: Column) -> Column:
    """In (0, 1), from a hash of the seed, a name and columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *of), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-53)


def _normal(seed: int, what: str, *of: Column) -> Column:
    """Box and Muller's standard normal."""
    radius = F.sqrt(-2.0 * F.log(_uniform(seed, f"{what}:r", *of)))
    return radius * F.cos(2.0 * math.pi * _uniform(seed, f"{what}:a", *of))


def _between(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def _by_archetype(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for a, v in values.items() for x in (a, v)))[F.col(ARCHETYPE)]


def perturbed(base: Column, noise: Column) -> Column:
    """24 shares of one day plus noise, at least ``FLOOR`` before they are made to sum to one again."""
    raw = F.zip_with(base, noise, lambda share, n: F.greatest(share + n, F.lit(FLOOR)))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda s, x: s + x))


def rolled(shape: Column, by: Column) -> Column:
    """A day whose peaks come ``by`` hours later (earlier if negative), around midnight."""
    return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.get(shape, F.pmod(h - by, F.lit(24))))


def consumers(spark: SparkSession, n: int, seed: int = 42, shares: dict[str, float] | None = None, perturbation: float = 0.15, max_shift: int = 2) -> DataFrame:
    """One row for each consumer: archetype, amplitude and its own 24 hourly shares.

    int(n * share) consumers of each archetype, the last one takes the rest; which ones is hashed.
    """
    shares = shares or SHARES
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError("shares of archetypes must sum to one")
    counts = [int(n * p) for p in shares.values()]
    bounds = [sum(counts[: i + 1]) for i in range(len(counts) - 1)]
    ids = spark.range(1, n + 1).withColumnRenamed("id", KEY)
    # A bijection of 0..n-1 spreads archetypes over ids without sorting anything.
    step = next(s for s in range(int(n * 0.618) | 1, 2 * n + 3) if math.gcd(s, n) == 1) if n > 1 else 1
    place = F.pmod((F.col(KEY) - 1) * F.lit(step) + F.lit(seed), F.lit(n))
    named = F.lit(list(shares)[-1])
    for name, bound in reversed(list(zip(shares, bounds, strict=False))):
        named = F.when(place < bound, name).otherwise(named)
    out = ids.withColumn(ARCHETYPE, named).withColumn("amplitude", _between(_uniform(seed, "amplitude", F.col(KEY)), 0.8, 2.5))
    base = F.create_map(*(x for a in TEMPLATES for x in (F.lit(a), F.array(*map(F.lit, template(a))))))[F.col(ARCHETYPE)]
    noise = F.array(*(perturbation * _normal(seed, f"shape{h}", F.col(KEY)) for h in range(24)))
    out = out.withColumn("base", base).withColumn("noise", noise).withColumn("own", perturbed(F.col("base"), F.col("noise")))
    shift = F.floor(_uniform(seed, "shift", F.col(KEY)) * (2 * max_shift + 1)).cast("int") - max_shift
    return out.select(KEY, ARCHETYPE, "amplitude", rolled(F.col("own"), shift).alias("shape"))


def season(time: Column) -> Column:
    """Temperature of a time by hour and day of the year."""
    day = 5.0 * F.sin(2.0 * math.pi * (F.hour(time) - 14) / 24.0)
    year = 5.0 * F.sin(2.0 * math.pi * (F.dayofyear(time) - 172) / 365.0)
    return 20.0 + day + year


def temperature(time: Column, seed: int) -> Column:
    """The same for all consumers at a time."""
    return season(time) + _normal(seed, "temperature", time)


def synthetic_panel(spark: SparkSession, n_consumers: int = 500, n_days: int = 30, hourly: bool = True, seed: int = 42, shares: dict[str, float] | None = None) -> DataFrame:
    """A panel with its hidden archetypes, hourly or daily, from 2024-01-01 on."""
    key, time = F.col(KEY), F.col(TIME)
    days = consumers(spark, n_consumers, seed, shares).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))))
    start = F.to_timestamp_ntz(F.lit(f"{START} 00:00:00"))
    if hourly:
        rows = days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
        rows = rows.withColumn(TIME, start + F.make_dt_interval(F.col("day"), F.col("h")))
        share, spread, noise = F.get("shape", F.col("h")), 0.15, 0.1
        spike = F.when(_uniform(seed, "spike", key, time) < 0.05, _between(_uniform(seed, "height", key, time), 1.5, 2.5)).otherwise(1.0)
        hours, warmth = 1.0, temperature(time, seed)
    else:
        rows = days.withColumn(TIME, start + F.make_dt_interval(F.col("day")))
        share, spread, noise, spike, hours = F.lit(1.0), 0.1, 0.05, F.lit(1.0), 24.0
        warmth = 20.0 + 5.0 * F.sin(2.0 * math.pi * F.col("day") / n_days) + _normal(seed, "temperature", key, time)
    factor = F.when(is_weekend(time), _by_archetype({a: w for a, (w, _) in WEEKEND_FACTORS.items()})).otherwise(_by_archetype({a: d for a, (_, d) in WEEKEND_FACTORS.items()}))
    value = (
        share * F.col("amplitude") * _between(_uniform(seed, "day", key, F.col("day")), 0.9, 1.1) * factor * spike
        * F.exp(spread * _normal(seed, "level", key, time))
        * (1.0 + noise * _normal(seed, "noise", key, time))
    )
    rows = rows.withColumn(VALUE, F.greatest(value, F.lit(FLOOR))).withColumns(
        {"volts": 230.0 + 5.0 * _normal(seed, "voltage", key, time), "power_factor": _between(_uniform(seed, "pf", key, time), 0.85, 0.98)}
    )
    return rows.select(
        KEY,
        TIME,
        VALUE,
        F.when(_uniform(seed, "missing", key, time) >= MISSING_VOLTAGE, F.col("volts")).alias("voltage_v"),
        (F.col(VALUE) / hours * 1000.0 / (F.col("volts") * F.col("power_factor"))).alias("current_a"),
        "power_factor",
        warmth.alias("temperature_c"),
        ARCHETYPE,
    )


def sinusoid_panel(spark: SparkSession, n_consumers: int = 500, n_days: int = 30, seed: int = 42) -> DataFrame:
    """The simpler hourly panel without archetypes: a daily wave on each consumer's own level."""
    key, time = F.col(KEY), F.col(TIME)
    start = F.to_timestamp_ntz(F.lit(f"{START} 00:00:00"))
    rows = spark.range(1, n_consumers + 1).select(F.col("id").alias(KEY), F.explode(F.sequence(F.lit(0), F.lit(24 * n_days - 1))).alias("h"))
    rows = rows.select(KEY, (start + F.make_dt_interval(hours=F.col("h"))).alias(TIME))
    wave = 1.0 + 0.5 * F.sin(2.0 * math.pi * (F.hour(time) - 6) / 24.0)
    level = _between(_uniform(seed, "level", key), 0.5, 3.0) * wave * F.when(is_weekend(time), 0.8).otherwise(1.0)
    value = level * F.exp(0.2 * _normal(seed, "noise", key, time))
    volts = F.when(_uniform(seed, "missing", key, time) >= 0.02, 230.0 + 5.0 * _normal(seed, "voltage", key, time))
    return rows.select(KEY, TIME, value.alias(VALUE), volts.alias("voltage_v"), temperature(time, seed).alias("temperature_c"))


def legacy_panel(spark: SparkSession, n_consumers: int = 500, n_days: int = 30, hourly: bool = True, seed: int = 42) -> DataFrame:
    """The older name and arguments of ``synthetic_panel``."""
    return synthetic_panel(spark, n_consumers, n_days, hourly, seed)
