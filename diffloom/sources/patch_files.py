"""Patch files of any size, read record by record.

The reader itself cuts at diff headers, so one large file is read by many
tasks, and no row holds more than a record. Within hunks every line begins
with a mark, so a line that begins with the header's words is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_text
from ..operators.order import placed
from .tables import written

#: Fixed value: how a record begins.
HEADER = "diff --git "


def patch_records(spark: SparkSession, path: str) -> DataFrame:
    """key, rec, raw, as operators.patch.records gives them of whole patches: key is the file's name, raw has one character for each byte.

    A file's records are numbered from 1 in its order; rec 0 is what stands
    before the first one. Empty files have none.
    """
    read = spark.read.option("lineSep", f"\n{HEADER}").text(path)
    # a reader's rows come in the order of the file, so their place is the split's and the one within it
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("key"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), byte_text(F.col("value").cast("binary")).alias("body"))
    rows = written(spark, rows, "records")
    at = placed(rows.drop("body"), [F.col("file"), F.col("block"), F.col("id")])
    ends = at.groupBy("file").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    told = rows.join(at.select("id", "place"), "id").join(ends, "file")
    first, last = F.col("place") == F.col("low"), F.col("place") == F.col("high")
    whole = F.concat(F.when(first, "").otherwise(HEADER), "body", F.when(last, "").otherwise("\n"))
    # a file that begins with a record has it in its first row
    begins = F.when(first, F.col("body").startswith(HEADER))
    headed = told.select("file", "key", (F.col("place") - F.col("low")).alias("n"), whole.alias("raw"), begins.alias("begins"))
    starts = headed.where("n = 0").select("file", F.when(F.col("begins"), 1).otherwise(0).alias("shift"))
    return headed.join(starts, "file").select("key", (F.col("n") + F.col("shift")).cast("long").alias("rec"), "raw").where("rec > 0 OR raw <> ''")
