"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled table of URLs (``LABELLED`` unless the caller
brings another one) and applied by DataFrame expressions and Spark ML only.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule
and gets the method's verdict for empty text; long URLs are used whole, in time linear in their
length; rows are judged one by one, so repeated rows get equal answers; of rules of equal length
the one with the longer host, then the one that sorts first, counts; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import common

#: (action, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
HASHED = 1 << 15
SIZES = (3, 4, 5)
THRESHOLD = 0.5
RIDGE = 0.001

#: Stems of hosts and paths from which the labelled table is made; 1 is blocked.
_BLOCKED = (
    "adult porn xxx sexcam escort casino poker slots jackpot betting viagra cialis pills steroid warez crack keygen torrent "
    "spam scam phish malware payday loan-shark free-money replica fake-id hot-singles giveaway click-here seo-links bets adserver tracking"
).split()
_ALLOWED = (
    "wiki library museum university weather garden recipe news science history travel blog docs school council football chess music "
    "photo poetry hiking clinic maps forum archive theatre software research museum-shop parish orchestra kitchen language family"
).split()
#: Parts that say nothing: they come with both labels alike.
_NEUTRAL = "world online hub city zone club portal center daily info net24 point".split()
_SYLLABLES = "ba do ki mu re to na li so ve th er an in ou st ing tion".split()


def _labelled() -> list[tuple[str, int]]:
    """URLs of many shapes for every stem, and hosts of invented names, which are allowed."""
    out = []
    for label, stems in ((1, _BLOCKED), (0, _ALLOWED)):
        for i, stem in enumerate(stems):
            part, other = _NEUTRAL[i % len(_NEUTRAL)], _NEUTRAL[(5 * i + 3) % len(_NEUTRAL)]
            out += [
                (f"https://www.{stem}-{part}.com/en/{100 + 31 * i}", label),
                (f"http://{other}{stem}.example.net/fr/{200 + 17 * i}.html", label),
                (f"https://m.{part}.info/{stem}/{other}?page={i}", label),
                (f"https://{stem}.{other}.co/index", label),
                (f"http://{stem}{part}.org/{i}", label),
                (f"https://my-{stem}.biz/{other}/{stem}-{i}", label),
            ]
    for i in range(192):
        name = "".join(_SYLLABLES[(i * k + k * k) % len(_SYLLABLES)] for k in range(1, 4 + i % 3))
        zone = ("com", "net", "info", "example.org")[i % 4]
        out.append((f"https://{('', 'www.', 'm.', 'blog.')[i // 4 % 4]}{name}.{zone}/{('de', 'en', 'es', 'fr')[i % 4]}/{i * 13}", 0))
    return out


#: A small table: 34 stems of each label in six shapes, and 192 invented names.
LABELLED = _labelled()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(common.lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its action; nulls where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]

    def pick(values: list[str]) -> Column:
        return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))

    return pick([h + p for _, h, p in ordered]), pick([a for a, _, _ in ordered])


def _grams(characters: Column, mark: str, size: int) -> Column:
    """All stretches of ``size`` characters, each after ``mark``; shifted copies side by side, so in linear time."""
    n = F.size(characters)
    side = F.arrays_zip(*(F.slice(characters, 1 + j, n) for j in range(size)))
    whole = F.slice(side, 1, F.greatest(n - (size - 1), F.lit(0)))
    return F.transform(whole, lambda z: F.concat(F.lit(mark), *(z[str(j)] for j in range(size))))


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``features``: counts of hashed character n-grams of ``^host$`` and ``^path$``."""
    framed = {f"_{c}": F.split(F.concat(F.lit("^"), F.col(c), F.lit("$")), "") for c in ("host", "path")}
    grams = [_grams(F.col(f"_{c}"), mark, n) for c, mark in (("host", "h:"), ("path", "p:")) for n in SIZES]
    hashed = HashingTF(numFeatures=HASHED, inputCol="_grams", outputCol="features")
    return hashed.transform(df.withColumns(framed).withColumn("_grams", F.concat(*grams))).drop("_grams", *framed)


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """``labelled``: (url, label) with label 1 for blocked; a small table, read once."""
    host, path = host_and_path(F.col("url"))
    rows = with_features(labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    rows = rows.where("label IS NOT NULL").coalesce(1).persist()
    share = rows.agg(F.avg("label").alias("share")).first()["share"] or 0.5
    even = F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))  # both labels weigh the same
    model = LogisticRegression(regParam=RIDGE, maxIter=100, standardization=False, weightCol="weight").fit(rows.withColumn("weight", even))
    rows.unpersist()
    return model


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    scored = model.transform(with_features(parsed))
    p_block = vector_to_array("probability")[1]
    return scored.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(action, F.when(p_block >= THRESHOLD, "block").otherwise("allow")).alias("verdict"),
        F.round(p_block, 6).alias("p_block"),
    )


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_table(spark)))
