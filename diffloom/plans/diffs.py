"""Queries over diffs of two snapshots: edits, rebuilt texts, hunks, renames by similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import ledger as L
from ..operators import patch as P
from ..operators import renames as R
from ..sources import substrate as S
from ..sources.tables import table, written
from .base import BASE


def sides(x):
    """doc_id, path, before, after: texts of both sides of a ledger, null where a side has no file; how they came about isn't looked at."""
    text = lambda other, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != other, F.struct(line, F.concat("content", F.when(F.col("no_newline"), "").otherwise("\n")).alias("raw"))))), lambda y: y["raw"]), "")
    rows = x.placed.groupBy("doc_id", "path").agg(text("after", "old_line").alias("b"), text("before", "new_line").alias("a"))
    return rows.select("doc_id", "path", F.nullif("b", F.lit("")).alias("before"), F.nullif("a", F.lit("")).alias("after"))


def diffed(spark, pairs):
    """The written script of pairs, its hunks and their patches."""
    script = written(spark, D.diff_lines(pairs), "script")
    side = lambda c, name: F.when(F.col(c).isNotNull(), F.col("path")).alias(name)
    blob = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(c, 256), 1, 40))
    mode = lambda c: F.when(F.col(c).isNotNull(), "100644")
    files = pairs.select(
        "doc_id", "path", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified").alias("status"), side("before", "old_path"), side("after", "new_path"),
        mode("before").alias("old_mode"), mode("after").alias("new_mode"), blob("before").alias("old_blob"), blob("after").alias("new_blob"), F.lit(False).alias("binary"),
    )
    hunks = L.hunks(S.hunk_lines(S.placed(script)), files)
    return script, hunks, P.write_patch(files, hunks)


def _line_diff(x):
    pairs = sides(x)
    return D.counted(D.diff_lines(pairs)).join(pairs.select("doc_id", "path"), "doc_id").select("doc_id", "path", "n_kept", "n_deleted", "n_inserted")


def _roundtrip(x):
    pairs = written(x.spark, sides(x), "sides")
    _, _, patches = diffed(x.spark, pairs)
    read = P.Patch(patches.withColumn("key", F.col("doc_id")).select("key", "patch"), "key", "patch")
    lines = read.text_lines.selectExpr("key AS doc_id", "side", "line", "content", "no_newline")
    rebuilt = D.applied(pairs.select("doc_id", F.coalesce("before", F.lit("")).alias("text")), lines)
    return rebuilt.select("doc_id", F.sha2("text", 256).alias("after_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


def _similar(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("doc_"), "doc_id")).alias("path"), "text", F.expr("doc_id % 3").alias("role"))
    return R.similar(docs.where("role <> 1").select("path", "text", (F.col("role") == 0).alias("removed")), docs.where("role = 1").select("path", "text"))


QUERIES = {"line_diff": _line_diff, "diff_roundtrip": _roundtrip}
#: Queries that take (spark, sf_dir).
PLAIN = {"similar_renames": _similar}

_side = lambda other, line: f"string_agg(content || CASE WHEN no_newline THEN '' ELSE chr(10) END, '' ORDER BY {line}) FILTER (kind <> '{other}')"
SQL = {
    # the longest common subsequence by its table, a row of it at a time: a row is the running maximum of the row above and of what a match adds
    "line_diff": f"""{BASE}, st AS MATERIALIZED (SELECT doc_id, path, list(content || CASE WHEN no_newline THEN '' ELSE chr(10) END ORDER BY old_line) FILTER (kind <> 'after') AS a, list(content || CASE WHEN no_newline THEN '' ELSE chr(10) END ORDER BY new_line) FILTER (kind <> 'before') AS b FROM p0 GROUP BY doc_id, path),
lcs AS (SELECT doc_id, 0 AS i, CAST(coalesce(len(a), 0) AS INTEGER) AS n, CAST(coalesce(len(b), 0) AS INTEGER) AS m, a, b, list_transform(range(coalesce(len(b), 0) + 1), lambda j: 0) AS r FROM st
  UNION ALL SELECT doc_id, i + 1, n, m, a, b, list_reduce(list_transform(range(1, m + 2), lambda j: [CASE WHEN j > 1 AND b[j - 1] = a[i + 1] THEN greatest(r[j], r[j - 1] + 1) ELSE r[j] END]), lambda p, q: list_append(p, greatest(p[-1], q[1]))) FROM lcs WHERE i < n),
kept AS (SELECT doc_id, n, m, CAST(r[-1] AS BIGINT) AS k FROM lcs WHERE i = n)
SELECT doc_id, path, k AS n_kept, n - k AS n_deleted, m - k AS n_inserted FROM kept JOIN st USING (doc_id)""",
    "diff_roundtrip": f"{BASE}, st AS (SELECT doc_id, coalesce({_side('before', 'new_line')}, '') AS t FROM p0 GROUP BY doc_id) SELECT doc_id, sha256(t) AS after_hash, CAST(strlen(t) AS BIGINT) AS n_bytes FROM st",
    "similar_renames": f"""WITH d AS (SELECT coalesce(source, 'none') || '/doc_' || doc_id AS path, text, doc_id % 3 AS role FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
l AS (SELECT path, role, line, count(*) AS n FROM (SELECT path, role, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$')) AS line FROM d) GROUP BY ALL),
s AS (SELECT a.path AS source_path, a.role AS role, b.path AS path, sum(least(a.n, b.n) * strlen(a.line)) AS shared FROM l a JOIN l b ON a.line = b.line AND a.role <> 1 AND b.role = 1 GROUP BY ALL),
p AS (SELECT s.*, CAST(shared * 100 // greatest(strlen(x.text), strlen(y.text)) AS BIGINT) AS score FROM s JOIN d x ON x.path = s.source_path JOIN d y ON y.path = s.path),
best AS (SELECT * FROM p WHERE score >= {R.LEAST} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, role, source_path) = 1)
SELECT path, source_path, score, CASE WHEN role = 0 AND row_number() OVER (PARTITION BY source_path ORDER BY score DESC, path) = 1 THEN 'renamed' ELSE 'copied' END AS kind FROM best""",
}
