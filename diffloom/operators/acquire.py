"""Patches of two snapshots: which files are new, gone, changed, renamed or copied, and their hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import substrate as S
from ..sources.tables import written
from . import diff as D
from . import ledger as L
from . import patch as P
from . import renames as R

#: Paths that a patch quotes: those with other than printable ASCII, quotes or backslashes.
ODD = r'[^\x20-\x7E]|["\\]'


def file_pairs(before: DataFrame, after: DataFrame, least: int = R.LEAST, copies: bool = True) -> DataFrame:
    """Files that differ between snapshots (path, mode, content): path, status, old_path, new_path, modes, similarity, before, after.

    A new file with a source similar enough is renamed, if the source is gone
    and this is its most similar target, or else copied. copies: whether files
    that stay are sources, too. Contents are strings; null ones are empty.
    """
    side = lambda df, name: df.select("path", F.col("mode").alias(f"{name}_mode"), F.coalesce("content", F.lit("")).alias(name))
    both = side(before, "old").join(side(after, "new"), "path", "full")
    changed = both.where("old IS NULL OR new IS NULL OR old <> new OR NOT (old_mode <=> new_mode)")
    gone, made = changed.where("new IS NULL"), changed.where("old IS NULL")
    stays = both.where("old IS NOT NULL AND new IS NOT NULL") if copies else both.where("false")
    sources = gone.select("path", F.col("old").alias("text"), F.lit(True).alias("removed")).unionByName(stays.select("path", F.col("old").alias("text"), F.lit(False).alias("removed")))
    found = written(before.sparkSession, R.similar(sources, made.select("path", F.col("new").alias("text")), least), "similar")
    moved = found.where("kind = 'renamed'").select(F.col("source_path").alias("path"))
    text = before.select(F.col("path").alias("source_path"), F.col("mode").alias("source_mode"), F.coalesce("content", F.lit("")).alias("source_text"))
    told = changed.join(moved, "path", "left_anti").join(found, "path", "left").join(text, "source_path", "left")
    return told.select(
        "path", F.coalesce("kind", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")).alias("status"),
        F.coalesce("source_path", F.when(F.col("old").isNotNull(), F.col("path"))).alias("old_path"), F.when(F.col("new").isNotNull(), F.col("path")).alias("new_path"),
        F.coalesce("old_mode", "source_mode").alias("old_mode"), "new_mode", F.col("score").cast("string").alias("similarity"), F.coalesce("old", "source_text").alias("before"), F.col("new").alias("after"),
    )


def acquired(before: DataFrame, after: DataFrame, context: int = S.CONTEXT, least: int = R.LEAST, copies: bool = True) -> DataFrame:
    """path, patch of each file that differs between two snapshots (path, mode, content), with so many lines of context.

    Files with a NUL are binary and have no hunks. The content of a nested
    repository is its commit.
    """
    if context < 0:
        raise ValueError("context must not be negative")
    spark = before.sparkSession
    pairs = written(spark, file_pairs(before, after, least, copies), "pairs")
    nested = lambda side: F.col(f"{side}_mode").eqNullSafe(L.SUBMODULE)
    blob = lambda c, side: F.when(nested(side), F.col(c)).when(F.col(c).isNotNull(), F.substring(F.sha2(c, 256), 1, 40))
    said = lambda c, side: F.when(nested(side), F.concat(F.lit("Subproject commit "), c, F.lit("\n"))).otherwise(F.col(c)).alias(c)
    same = F.col("before").eqNullSafe(F.col("after"))
    files = pairs.select("*", F.col("path").alias("doc_id"), F.when(~same, blob("before", "old")).alias("old_blob"), F.when(~same, blob("after", "new")).alias("new_blob"), F.coalesce(F.instr("before", "\0") + F.instr("after", "\0") > 0, F.instr(F.coalesce("before", "after"), "\0") > 0).alias("binary"))
    script = written(spark, D.diff_lines(files.where("NOT binary").select("doc_id", "path", said("before", "old"), said("after", "new"))), "script")
    hunks = L.hunks(S.hunk_lines(S.placed(script), context), files, F.lit(""))
    return P.write_patch(files.drop("before", "after"), hunks, F.col("doc_id").rlike(ODD)).select("path", "patch")


def one_patch(patches: DataFrame) -> DataFrame:
    """patch: all patches (path, patch) as one text in the order of their paths; for comparisons that fit a row."""
    return patches.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "patch"))), lambda x: x["patch"]), "").alias("patch"))
