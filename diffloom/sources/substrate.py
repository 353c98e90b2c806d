"""Before and after snapshots derived from documents, by integer rules.

doc_id % 23 gives a file's status, (31 doc_id + line_no) % 11 the edit of a
line, doc_id % 20 its directory and suffix. Rows whose id or text is null are
no files. Documents are dealt by id once; all windows of a file then run where
its text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import bytes_of, table

#: Values of ours: status by doc_id % 23 (others are modified); directory and ending of the path by doc_id % 20.
STATUS = {0: "added", 1: "deleted", 2: "renamed", 3: "copied", 4: "mode", 5: "binary", 6: "submodule"}
PLACES = [
    "src/app|.py", "tests|.py", "docs|.md", "config|.yaml", "schema|.json", "generated|.ts", "src/lib|.min.js", "deps|/requirements.txt", "src/core|.rs", "data|.csv",
    "misc|.bin", "src/ui|.go", "deps|/Cargo.lock", "etc|/.eslintrc", "etc|/Makefile", "src|/api.schema.graphql", "web|/page.test.tsx", "notes|.rst", "ci/.github|/run.sh", "src|.JSX",
]
CONTEXT = 3
#: Bytes of stored documents that a task takes, about; lines with their windows need many times that.
SHARE = 8 << 20
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEHIND = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def shares(spark: SparkSession, sf_dir: str) -> int:
    """The tasks that documents are dealt to: as many as the input has shares, and one for each core at least."""
    return max(-(-bytes_of(spark, f"{sf_dir}/documents.parquet") // SHARE), spark.sparkContext.defaultParallelism)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: doc_id, source, text, path, old_path, new_path, status, modes, blobs, edit (rule for its lines), eof (no line feed at the end)."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", "text")
    # a stated number, so that tables written in as many buckets lie as the files do
    docs = docs.repartition(shares(spark, sf_dir), "doc_id")
    rule = F.coalesce(*[F.when(F.col("doc_id") % 23 == k, F.lit(v)) for k, v in STATUS.items()], F.lit("modified"))
    place = F.split(F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("doc_id") % len(PLACES) + 1).cast("int")), r"\|")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), place[0], F.concat(F.lit("doc_"), F.col("doc_id"), place[1]))
    edit = F.when(F.col("rule").isin("added", "deleted"), F.col("rule")).when(F.col("rule").isin("mode", "binary", "submodule"), "none").when(F.col("doc_id") % 29 == 6, "spaces").otherwise("lines")
    named = docs.select("*", rule.alias("rule"), path.alias("path"))
    had, has = F.col("rule") != "added", F.col("rule") != "deleted"
    blob = lambda side: F.substring(F.sha2(F.concat(F.lit(f"{side}:"), "text"), 256), 1, 40)
    kind = lambda other: F.when(F.col("rule") == "submodule", "160000").otherwise(other)
    return named.select(
        "doc_id", "source", "text", "path",
        F.when(F.col("rule").isin("mode", "binary", "submodule"), "modified").otherwise(F.col("rule")).alias("status"),
        F.when(had, F.when(F.col("rule").isin("renamed", "copied"), F.concat("path", F.lit(".orig"))).otherwise(F.col("path"))).alias("old_path"),
        F.when(has, F.col("path")).alias("new_path"),
        F.when(had, kind("100644")).alias("old_mode"),
        F.when(has, kind(F.when(F.col("rule") == "mode", "100755").otherwise("100644"))).alias("new_mode"),
        F.when(had & (F.col("rule") != "mode"), blob("old")).alias("old_blob"),
        F.when(has & (F.col("rule") != "mode"), blob("new")).alias("new_blob"),
        (F.col("rule") == "binary").alias("binary"), edit.alias("edit"), (~F.col("text").endswith("\n")).alias("eof"),
    )


def lines(files_: DataFrame) -> DataFrame:
    """doc_id, path, edit, eof, n (lines of the file), line_no from 1, content; split at \\n only, one trailing empty line dropped."""
    parts = F.split("text", "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files_.select("doc_id", "path", "edit", "eof", whole.alias("w")).select("doc_id", "path", "edit", "eof", F.size("w").alias("n"), F.posexplode("w").alias("p", "content")).select("doc_id", "path", "edit", "eof", "n", (F.col("p") + 1).cast("long").alias("line_no"), "content")


def events(lines_: DataFrame) -> DataFrame:
    """Kept, deleted and inserted lines: doc_id, path, line_no, kind (keep, before, after), content, no_newline."""
    k = (F.col("doc_id") * 31 + F.col("line_no")) % 11
    one = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    text = F.col("content")
    keep, gone = F.array(one("keep", text)), F.array(one("before", text))
    spaced = F.array(one("before", text), one("after", F.replace(text, F.lit(" "), F.lit("  "))))
    edited = F.array(one("before", text), one("after", F.concat(text, F.lit(" ~"))))
    added = F.array(one("keep", text), one("after", F.concat(F.lit("+ "), text)))
    by_line = F.when(k == 0, gone).when(k == 1, edited).when(k == 2, added).otherwise(keep)
    made = (
        F.when(F.col("edit") == "added", F.array(one("after", text)))
        .when(F.col("edit") == "deleted", gone)
        .when(F.col("edit") == "none", keep)
        .when(F.col("edit") == "spaces", F.when((k == 1) & text.contains(" "), spaced).otherwise(keep))
        .otherwise(by_line)
    )
    # a line that is followed by an inserted one has its line feed on both sides
    bare = F.col("eof") & (F.col("line_no") == F.col("n")) & ~((F.col("edit") == "lines") & (k == 2))
    return lines_.select("doc_id", "path", "line_no", bare.alias("no_newline"), F.explode(made).alias("e")).select("doc_id", "path", "line_no", "e.kind", "e.content", "no_newline")


def placed(events_: DataFrame) -> DataFrame:
    """Events with block (kept lines so far), old_line and new_line (lines of each side so far)."""
    at = "PARTITION BY doc_id ORDER BY line_no, IF(kind = 'after', 1, 0)"
    return events_.selectExpr(
        "*",
        f"sum(IF(kind = 'keep', 1L, 0L)) OVER ({at} {UPTO}) AS block",
        f"sum(IF(kind <> 'after', 1L, 0L)) OVER ({at} {UPTO}) AS old_line",
        f"sum(IF(kind <> 'before', 1L, 0L)) OVER ({at} {UPTO}) AS new_line",
    )


def hunk_lines(placed_: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Placed lines of hunks, kept ones included, with hunk_no and pos (order in the hunk).

    A block is a run without kept lines; a hunk has the blocks with at most
    twice the context between them, and so many kept lines around them. Within
    a block deletions come before insertions.
    """
    at = "PARTITION BY doc_id ORDER BY line_no, IF(kind = 'after', 1, 0)"
    back = "PARTITION BY doc_id ORDER BY line_no DESC, IF(kind = 'after', 1, 0) DESC"
    near = placed_.selectExpr("*", f"last(IF(kind <> 'keep', block, NULL), true) OVER ({at} {BEHIND}) AS gone", f"last(IF(kind <> 'keep', block, NULL), true) OVER ({back} {BEHIND}) AS coming")
    begun = near.selectExpr("*", f"sum(IF(kind <> 'keep' AND (gone IS NULL OR block - gone > {2 * context}), 1L, 0L)) OVER ({at} {UPTO}) AS begun")
    hunk = f"CASE WHEN kind <> 'keep' OR block - gone <= {context} OR coming - gone <= {2 * context} THEN begun WHEN coming - block < {context} THEN begun + 1 END"
    inside = begun.selectExpr("doc_id", "path", "kind", "content", "no_newline", "block", "old_line", "new_line", f"{hunk} AS hunk_no").where("hunk_no IS NOT NULL")
    order = "CASE kind WHEN 'keep' THEN 0 WHEN 'before' THEN 1 ELSE 2 END"
    return inside.selectExpr("*", f"row_number() OVER (PARTITION BY doc_id, hunk_no ORDER BY block, {order}, IF(kind = 'after', new_line, old_line)) - 1L AS pos")


def changes(hunk_lines_: DataFrame) -> DataFrame:
    """Changed lines: doc_id, path, side, line, block, hunk_no, ordinal, content, no_newline."""
    rows = hunk_lines_.where("kind <> 'keep'")
    return rows.selectExpr("doc_id", "path", "kind AS side", "IF(kind = 'before', old_line, new_line) AS line", "block", "hunk_no", "row_number() OVER (PARTITION BY doc_id, hunk_no ORDER BY pos) - 1L AS ordinal", "content", "no_newline")


def substrate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, lines, placed events, lines of hunks)."""
    f = files(spark, sf_dir)
    return f, *of_files(f)


def of_files(files_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, placed events, lines of hunks)."""
    ln = lines(files_)
    at = placed(events(ln))
    return ln, at, hunk_lines(at)
