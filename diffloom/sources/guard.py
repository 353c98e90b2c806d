"""A guard against inputs that change while they are read."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Changed(RuntimeError):
    """Files that a query read aren't what they were when it began."""


def fingerprint(spark: SparkSession, *paths: str) -> DataFrame:
    """path, bytes, modified of every file at paths, by the file listing alone; hidden files don't count."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def stamp(spark: SparkSession, *paths: str) -> tuple[int, int, int]:
    """The number of files, their bytes and a hash over all of them; the hash doesn't depend on their order."""
    for path in paths:
        spark.catalog.refreshByPath(path)
    each = F.xxhash64("path", "bytes", "modified")
    found = fingerprint(spark, *paths).distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.expr("bit_xor(xxhash64(path, bytes, modified))"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(each, F.lit(1 << 31))), F.lit(0)).alias("y")).first()
    return found.n, found.bytes, found.x ^ found.y


@contextmanager
def unchanged(spark: SparkSession, *paths: str):
    """Raises Changed if the files at paths aren't the same at the end as at the beginning; for the time in which a result is computed and written."""
    before = stamp(spark, *paths)
    yield before
    if (after := stamp(spark, *paths)) != before:
        raise Changed(f"{after[0]} files of {after[1]} bytes instead of {before[0]} of {before[1]}, or others: {', '.join(paths)}")


def consistent(build, *frames: DataFrame) -> DataFrame:
    """What build() gives, which is to have run by its end (a written table), guarded over the folders that frames read."""
    spark = frames[0].sparkSession
    paths = sorted({at.rpartition("/")[0] for df in frames for at in df.inputFiles()})
    with unchanged(spark, *paths):
        return build()
