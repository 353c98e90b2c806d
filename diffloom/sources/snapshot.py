"""Snapshots as tables (side, path, mode, object, content): point reads, safe paths, untracked files, keys and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_of, normal_path, parts_of, stable_id, suffix_of
from ..functions.text import quoted
from ..operators.ledger import MARKER, of_range

#: Names and suffixes of files that hold credentials.
SENSITIVE_NAMES = [".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_rsa", "id_ed25519"]
SENSITIVE_SUFFIXES = [".pem", ".key", ".p12", ".pfx"]
#: Modes of nested repositories, symbolic links, executables and plain files.
NESTED, LINK, EXECUTABLE, PLAIN = "160000", "120000", "100755", "100644"


def safe_path(path: Column | str) -> Column:
    """Whether a source path may be read: relative, without .. and .git, and no name of credentials."""
    path = F.col(path) if isinstance(path, str) else path
    parts = parts_of(path)
    return F.coalesce(~path.startswith("/") & ~F.array_contains(parts, "..") & ~F.array_contains(parts, ".git") & ~F.lower(name_of(path)).isin(SENSITIVE_NAMES) & ~F.coalesce(suffix_of(path), F.lit("")).isin(SENSITIVE_SUFFIXES), F.lit(False))


def source_of(wanted: DataFrame, snapshot: DataFrame) -> DataFrame:
    """wanted (side, path) with content; null where the path is missing, stands twice, or is a nested repository."""
    one = snapshot.where(F.coalesce(F.col("mode"), F.lit("")) != NESTED).groupBy("side", "path").agg(F.count("*").alias("n"), F.first("content").alias("content")).where("n = 1").drop("n")
    return wanted.join(one, ["side", "path"], "left")


def normalised(content: Column) -> Column:
    """Text with line feeds only."""
    return F.regexp_replace(content, "\r\n", "\n")


def materialised(snapshot: DataFrame) -> DataFrame:
    """The files of a snapshot that may be read; links and nested repositories are listed without content."""
    return snapshot.where(safe_path("path")).withColumn("content", F.when(~F.coalesce(F.col("mode"), F.lit("")).isin(NESTED, LINK), F.col("content")))


def snapshot_key(side: Column, kind: Column, identity: Column) -> Column:
    """The key under which a side's files are kept."""
    return F.sha2(F.to_json(F.array(F.lit("snapshot/v1"), side, kind, identity)), 256)


def unmerged(index: DataFrame) -> DataFrame:
    """Index entries (path, stage) of unresolved merges; there must be none before changes are counted."""
    return index.where("stage <> 0").select("path", "stage")


def untracked(tracked: DataFrame, worktree: DataFrame) -> DataFrame:
    """Files of the working tree (path, mode, content, object) that aren't tracked (path), as added files with their patch header and whole patch.

    A link's content is its target; an empty file has no lines. A nested
    repository has none either, and its patch names its commit (object). Files
    with a NUL are binary.
    """
    rows = worktree.join(tracked.select("path"), "path", "left_anti")
    zero = F.lit("0" * 40)
    old, new = quoted(F.col("path"), "a/"), quoted(F.col("path"), "b/")
    head = F.concat(F.lit("diff --git "), old, F.lit(" "), new, F.lit("\nnew file mode "), "mode", F.lit("\nindex "), zero, F.lit(".."), "object", F.lit("\n"))
    count = F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    lines = F.when((F.col("mode") == NESTED) | (F.coalesce("content", F.lit("")) == ""), 0).otherwise(count).cast("long")
    text = F.when(F.col("mode") == NESTED, F.concat(F.lit("Subproject commit "), "object", F.lit("\n"))).otherwise(F.coalesce("content", F.lit("")))
    shown = F.when(F.col("mode") == NESTED, 1).otherwise(F.col("n_lines"))
    plain = F.when(F.col("_t").endswith("\n"), F.left("_t", F.length("_t") - 1)).otherwise(F.col("_t"))
    hunk = F.concat(F.lit("--- /dev/null\n+++ "), new, F.lit("\n@@ -0,0 +"), of_range(F.lit(1), shown), F.lit(" @@\n+"), F.replace(plain, F.lit("\n"), F.lit("\n+")), F.lit("\n"), F.when(F.col("_t").endswith("\n"), "").otherwise(F.lit(MARKER + "\n")))
    body = F.when(F.col("_t") == "", "").when(F.instr("_t", "\0") > 0, F.concat(F.lit("Binary files /dev/null and "), new, F.lit(" differ\n"))).otherwise(hunk)
    told = rows.select("path", F.lit("added").alias("status"), "mode", "object", lines.alias("n_lines"), head.alias("header"), text.alias("_t"))
    return told.withColumn("patch", F.concat("header", body)).drop("_t")


def invalid_references(references: DataFrame, snapshot: DataFrame) -> DataFrame:
    """references (id, path, line) whose path isn't in the snapshot (path, n_lines) or whose line isn't in the file; a null line asks for the file only."""
    known = snapshot.select("path", "n_lines")
    rows = references.withColumn("path", normal_path("path")).join(known, "path", "left")
    return rows.where("n_lines IS NULL OR line < 1 OR line > n_lines").select("id")


def repository_id(storage: Column, origin: Column) -> Column:
    """The identity of a repository by its storage and the address of its origin (null: empty)."""
    return F.sha2(F.to_json(F.array(F.lit("repository/v1"), storage, F.coalesce(F.trim(origin), F.lit("")))), 256)


def index_key(repository: Column, snapshot: Column, provider: str = "symbols/v1") -> Column:
    """The key of a graph index: it names the provider, so that another one's tables are not used."""
    return F.sha2(F.to_json(F.array(F.lit("graph-index/v1"), F.lit(provider), repository, snapshot)), 256)


def usable_index(manifests: DataFrame, expected: DataFrame, payloads: DataFrame) -> DataFrame:
    """key, usable of expected indexes (key, and facts): the manifest has the same facts, and the payload the hash that the manifest names."""
    facts = [c for c in expected.columns if c != "key"]
    theirs = manifests.select("key", *[F.col(c).alias(f"m_{c}") for c in facts], "payload_hash")
    rows = expected.join(theirs, "key", "left").join(payloads.select("key", F.col("content_hash").alias("found")), "key", "left")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return rows.select("key", F.coalesce(same & (F.col("payload_hash") == F.col("found")), F.lit(False)).alias("usable"))

