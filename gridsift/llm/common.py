"""Helpers shared by the training-data operators.

Word rule used throughout: A-Z are lower-cased, words are maximal runs of bytes
other than 0x20 and 0x09-0x0D.  ``bytes.lower`` and ``bytes.split`` do exactly that.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(ship, "sent_to", None) == context.applicationId:
        return
    target = Path(tempfile.mkdtemp(prefix="gridsift-")) / "gridsift_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    ship.sent_to = context.applicationId


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None)
        if folder is None or not os.path.isdir(folder):
            folder = shared_folder.own = tempfile.mkdtemp(prefix="spark-gridsift-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gridsift/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.gridsift_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "gridsift_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(column):
    return F.translate(column, _UPPER, _LOWER)


def crc_mod(column, modulus: int):
    """crc32 of the number written as text, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


_TENANT: dict[str, object] = {}


def give_back() -> None:
    """Hand memory that is free in this process back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tenant(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps for ``name`` from task to task, made if it is not there.

    Workers outlive stages and operators, so only one of these is kept at a time: what an
    earlier operator kept is dropped, and its memory given back, before ``make`` is called.
    """
    if name not in _TENANT:
        if _TENANT:
            _TENANT.clear()
            give_back()
        _TENANT[name] = make()
    return _TENANT[name]


class WordHashes(dict):
    """64-bit hashes of words, kept between batches up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    return tenant("words", WordHashes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps around by intent)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def as_binary(column):
    """UTF-8 bytes of an Arrow string column, as a column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def text_bytes(column) -> list[bytes | None]:
    return as_binary(column).to_pylist()


def portions(texts, size: int) -> Iterator[slice]:
    """Stretches of about ``size`` bytes of an Arrow string column; a longer text is a stretch of its own."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield slice(a, b)


def unique_by_id(docs: DataFrame, key: str, value: str) -> DataFrame:
    """``docs`` with one row for each key; the smallest value stays where a key repeats.

    Only the key column is read to find out whether any key repeats at all.
    """
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"), F.count(key).alias("k")).first()
    if row["n"] == row["d"]:
        return docs.select(key, value)
    return docs.groupBy(key).agg(F.min(value).alias(value))


def by_place(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the needed columns under their own names and all others under names that clash with
    nothing, and what every column was called: {name now: name before}.

    A needed column is the one of exactly that name, else the first that differs in case only.  Columns are
    renamed by place, so names that differ in case only, and those with dots or backticks, do no harm.
    """
    names = docs.columns
    found = {}
    for column in needed:
        same = [i for i, n in enumerate(names) if n == column] or [i for i, n in enumerate(names) if n.lower() == column.lower()]
        if not same:
            raise ValueError(f"no column {column}")
        found[same[0]] = column
    now = [found.get(i, f"_extra{i}") for i in range(len(names))]
    return docs.toDF(*now), dict(zip(now, names, strict=True))


def renamed(df: DataFrame, before: dict[str, str], *added: str) -> DataFrame:
    """The columns of ``before`` under their old names, then those added; of an old column called like an added one, in any case, the added one stays."""
    taken = {a.lower() for a in added}
    kept = [(now, old) for now, old in before.items() if old.lower() not in taken]
    return df.select(*(now for now, _ in kept), *added).toDF(*(old for _, old in kept), *added)
