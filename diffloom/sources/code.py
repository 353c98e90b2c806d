"""Source texts derived from documents, by integer rules: three lines of code for each line of a document.

The i-th line of document d becomes a function named f<(7 d + i) % 500> that
calls f<(3 d + 5 i) % 500> and has the line as a comment. Every 17th document
doesn't parse. Files are those of the after side; their language is that of
the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import suffix_of
from ..functions.symbols import BRACES, SUPPORTED

NAMES = 500


def functions(lines: DataFrame) -> DataFrame:
    """doc_id, path, line_no, caller, callee, content of each line's function."""
    return lines.selectExpr("doc_id", "path", "line_no", f"concat('f', (7 * doc_id + line_no) % {NAMES}) AS caller", f"concat('f', (3 * doc_id + 5 * line_no) % {NAMES}) AS callee", "content")


def sources(files: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, path, text, n_lines of files that have an after side and are of a supported language."""
    end, python = suffix_of("path"), suffix_of("path") == ".py"
    made = functions(lines).join(files.where("new_path IS NOT NULL").select("doc_id").hint("merge"), "doc_id", "left_semi").where(end.isin(SUPPORTED))
    body = F.when(python, F.concat(F.lit("def "), "caller", F.lit("(x):  # "), "content", F.lit("\n    y = "), "callee", F.lit("(x)\n    return y"))).otherwise(F.concat(F.lit("function "), "caller", F.lit("(x) { // "), "content", F.lit("\n  return "), "callee", F.lit('(x) + "}";\n}')))
    rows = made.withColumn("body", body).groupBy("doc_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), "\n").alias("text"), (3 * F.count("*")).alias("n"))
    broken = F.col("doc_id") % 17 == 4
    tail = F.when(broken, F.when(python, "\ndef (").otherwise("\n}")).otherwise("")
    return rows.select("doc_id", "path", F.concat("text", tail).alias("text"), (F.col("n") + broken.cast("int")).alias("n_lines"))


def is_brace(path: str = "path"):
    return suffix_of(path).isin(BRACES)
