"""Renames and copies found by similarity of content.

Similarity is the bytes of lines that two files share, of each line as often as
both have it, in hundredths of the larger file's bytes. Only pairs from a
threshold on are looked for: with lines in order of how many files hold them,
rarest first, two such files share a line among those that begin within the
bytes that a file can do without, so lines that everything shares are met only by files that
consist of nothing else. Files of equal content are one entry of the index, so
a group of copies costs what one file does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Fixed value: hundredths of similarity from which a file counts as renamed or copied.
LEAST = 50


def indexed(files: DataFrame) -> DataFrame:
    """content, line, n, bytes, size: how often each line stands in each content of files (text), with its bytes and the content's."""
    parts = F.filter(F.split("text", "(?<=\n)"), lambda x: x != "")
    each = files.select(F.sha2("text", 256).alias("content"), "text").dropDuplicates(["content"]).select("content", F.octet_length("text").cast("long").alias("size"), F.explode(parts).alias("x"))
    return each.groupBy("content", "size", F.unhex(F.md5("x")).alias("line")).agg(F.count("*").alias("n"), F.first(F.octet_length("x")).cast("long").alias("bytes"))


def candidates(index: DataFrame, left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs (source, target) of contents of left and right that share one of their rare lines; all pairs from the threshold on are among them."""
    held = index.groupBy("line").agg(F.count("*").alias("held"))
    order = "PARTITION BY content ORDER BY held, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    early = index.join(held, "line").selectExpr("content", "line", "size", f"coalesce(sum(n * bytes) OVER ({order}), 0) AS ahead").where(F.col("ahead") * 100 <= F.col("size") * (100 - least)).select("content", "line")
    side = lambda of, name: early.join(of.select("content").distinct(), "content", "left_semi").withColumnRenamed("content", name)
    return side(left, "source").join(side(right, "target"), "line").where("source <> target").select("source", "target").distinct()


def similarities(index: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """source, target, score of pairs from the threshold on."""
    rows = index.select("content", "line", "n", "bytes", "size")
    a = pairs.join(rows.withColumnsRenamed({"content": "source", "n": "n_source", "size": "size_source"}), "source")
    both = a.join(rows.selectExpr("content AS target", "line", "n AS n_target", "size AS size_target"), ["target", "line"])
    shared = both.groupBy("source", "target").agg(F.sum(F.least("n_source", "n_target") * F.col("bytes")).alias("shared"), F.first("size_source").alias("a"), F.first("size_target").alias("b"))
    return shared.select("source", "target", F.floor(F.col("shared") * 100 / F.greatest("a", "b")).cast("long").alias("score")).where(F.col("score") >= least)


def similar(sources: DataFrame, targets: DataFrame, least: int = LEAST) -> DataFrame:
    """path, source_path, score, kind of targets (path, text), files that are new, that have a source (path, text, removed) from the threshold on.

    The most similar source counts, of equal ones the first by path. A source
    that is removed is renamed to its most similar target, of equal ones the
    first by path; all others are copies. Empty files have no source.
    """
    content = F.sha2("text", 256)
    old = sources.where("text <> ''").select(content.alias("source"), F.col("path").alias("source_path"), "removed")
    new = targets.where("text <> ''").select(content.alias("target"), "path")
    spark = sources.sparkSession
    index = written(spark, indexed(sources.where("text <> ''").select("text").unionByName(targets.where("text <> ''").select("text"))), "lines")
    scored = similarities(index, candidates(index, old.withColumnRenamed("source", "content"), new.withColumnRenamed("target", "content"), least), least)
    # of files of equal content one that is removed goes first, then the first by path
    held = old.groupBy("source").agg(F.min(F.struct((~F.col("removed")).alias("stays"), "source_path")).alias("x"))
    same = new.select("target").distinct().join(old.select("source").distinct(), F.col("target") == F.col("source")).select("source", "target", F.lit(100).cast("long").alias("score"))
    order = F.struct((-F.col("score")).alias("minus"), "x.stays", "x.source_path")
    best = scored.unionByName(same).join(held, "source").groupBy("target").agg(F.min(order).alias("y"))
    chosen = new.join(best, "target").select("path", "y.source_path", (-F.col("y.minus")).alias("score"), (~F.col("y.stays")).alias("removed"))
    moved = chosen.where("removed").groupBy("source_path").agg(F.min(F.struct((-F.col("score")).alias("minus"), "path")).alias("z")).select(F.col("z.path").alias("path"), F.lit("renamed").alias("kind"))
    return chosen.join(moved, "path", "left").select("path", "source_path", "score", F.coalesce("kind", F.lit("copied")).alias("kind"))
