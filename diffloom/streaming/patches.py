"""Patches that arrive as files, parsed batch by batch into one ledger.

An addition of ours: line ids are content-addressed, so a file that is read
again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..operators.patch import parse_patch


def ledger_stream(spark: SparkSession, folder: str, to: str, checkpoint: str):
    """Starts a query that appends changed lines of new patch files in folder to the Parquet table at to."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("value").alias("patch"), F.sha2("value", 256).alias("path"))

    def add(batch: DataFrame, _: int) -> None:
        lines = parse_patch(batch.dropDuplicates(["path"])).withColumn("line_id", stable_id("line", "key", "path", "hunk_no", "side", "line", "ordinal", "content_hash", "no_newline"))
        try:
            known = spark.read.parquet(to).select("line_id")
        except Exception as e:  # the table isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lines.write.mode("append").parquet(to)
        else:
            lines.join(known, "line_id", "left_anti").write.mode("append").parquet(to)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
