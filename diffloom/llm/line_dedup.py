"""Line dedup: fuzzy lines by MinHash over character shingles, one line kept per component.

Lines are cut at \\n; a line without a word is no unit and stays with its
document. Shingles are windows of SHINGLE characters, in lines of any length. Two
lines link when the Jaccard similarity of their sets is PERCENT or more. A
letter changed within a line of 59 or more characters leaves it linked, and so
does a word of five letters within one of 95 or more. BANDS bands of ROWS rows
find a pair at the least similarity with a chance of 0.9994, more similar ones
more often. Shorter shingles, which bear edits in shorter lines, are so common
in lines of one language that these meet by chance the more often the more
there are. See near_units for ids, nulls, ties and very long lines. A document that loses all its
lines is dropped: its lines stand elsewhere. One that had no line to begin with
stays. Columns of any name are kept as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_units import Units, grams, unit_classes
from .shared import counts, fresh, table

SHINGLE, PERCENT, BANDS, ROWS = 6, 80, 14, 4


def find_lines(data: np.ndarray, offsets: np.ndarray):
    breaks = np.flatnonzero(data == 10)
    cut = np.zeros(len(data) + 2, bool)
    cut[offsets] = cut[breaks + 1] = True
    begin = np.flatnonzero(cut[: len(data)])
    begin = begin[data[begin] != 10]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = cut[breaks] = True
    stops = np.flatnonzero(cut)
    end = stops[np.searchsorted(stops, begin, "right")] if len(begin) else begin
    solid = counts(~((data == 32) | ((data >= 9) & (data <= 13))))
    full = solid[end] > solid[begin]
    begin, end = begin[full], end[full]
    return np.searchsorted(offsets, begin, "right") - 1, begin, end, solid[end] - solid[begin]


def _codes(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def line_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    points = counts((data & 0xC0) != 0x80)
    return grams(_codes(data), points[begin], points[end], SHINGLE)


LINES = Units(find_lines, line_hashes, BANDS, ROWS)


def kept_lines(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, text_hash, n_lines; kept: doc_id, text_hash, lines as sorted places among its lines)."""
    places, nodes = unit_classes(spark, docs, LINES, PERCENT, "lines")
    firsts = nodes.where("NOT linked").select("keep").unionByName(nodes.where("linked").select("keep").distinct())
    kept = firsts.groupBy("keep.doc_id", "keep.text_hash").agg(F.array_sort(F.collect_list("keep.no")).alias("lines"))
    return places.groupBy("doc_id", "text_hash").agg((F.max("no") + 1).cast("long").alias("n_lines")), kept


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with their remaining lines as text, all columns kept; documents that lose every line are dropped."""
    _, kept = kept_lines(spark, docs)
    d, h, left, t, s = fresh(docs, "_d", "_h", "_lines", "_t", "_s")
    kept = kept.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("lines").alias(left))
    joined = docs.withColumn(t, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(h)), "left")
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # places among the lines with words; a line without any goes with its document's first kept line
    shorter = F.array_join(F.transform(F.col(left), lambda k: F.get(s, k)), "\n")
    text = F.when(F.col(left).isNotNull() & (F.size(left) < F.size(s)), shorter).otherwise(F.col("text"))
    return joined.withColumn(s, solid).where((F.size(s) <= 0) | F.col(left).isNotNull() | F.col("text").isNull()).withColumn("text", text).drop(d, h, t, s, left)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes, kept = kept_lines(spark, docs)
    per = sizes.join(kept.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return per.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_kept"), F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("kept_lines"))
