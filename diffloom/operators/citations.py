"""Source citations of spans, verification against the snapshots, and the evidence budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import ascii_json
from ..sources.tables import written
from .ledger import digest, listed, together
from .order import placed

#: Values of ours: what a citation's text can be fetched by, and the messages of the budget.
SOURCE_RANGE, SOURCE_CONTEXT = "source_range", "source_context"
EXCEEDED = ("evidence_budget_exceeded", "The ledger without any source text is larger than the budget; all ids are kept.")
OMITTED = ("evidence_context_omitted", "Source text was left out to stay within the budget; it can be fetched again.")


def snapshot_lines(placed: DataFrame) -> DataFrame:
    """doc_id, path, side, line, content of both sides."""
    sides = F.filter(F.array(F.when(F.col("kind") != "after", F.struct(F.lit("before").alias("side"), F.col("old_line").alias("line"))), F.when(F.col("kind") != "before", F.struct(F.lit("after").alias("side"), F.col("new_line").alias("line")))), lambda x: x.isNotNull())
    return placed.select("doc_id", "path", "content", F.explode(sides).alias("s")).select("doc_id", "path", "s.side", "s.line", "content")


def citations(spans: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One per span: the lines of its range on its side, joined by line feeds. Every line of a range meets its snapshot line by number.

    They meet in a window over both (see ledger.together).
    """
    path = F.when(F.col("side") == "before", F.col("old_path")).otherwise(F.col("new_path"))
    s = spans.select("doc_id", "side", path.alias("path"), "span_id", "start_line", "end_line", F.array_join("line_ids", ",").alias("cited"))
    # what a span has besides its lines goes with its first line
    rest = ["path", "start_line", "end_line", "cited"]
    lines = F.explode(F.when(F.col("span_id").isNotNull(), F.sequence("start_line", "end_line")).otherwise(F.array("line"))).alias("line")
    both = together("doc_id", s, snapshot.select("doc_id", "side", "line", "content")).select("doc_id", "side", "span_id", "content", F.when(F.col("span_id").isNotNull(), F.struct(*rest)).alias("own"), lines)
    at = "OVER (PARTITION BY doc_id, side, line)"
    rows = both.selectExpr("doc_id", "side", "span_id", "line", "IF(line = own.start_line, own, NULL) AS own", f"max(content) {at} AS content", f"count(content) {at} AS n").where("span_id IS NOT NULL AND n > 0")
    out = rows.groupBy("doc_id", "side", "span_id").agg(listed(F.array_sort(F.collect_list(F.struct("line", "content"))), "content", "\n").alias("text"), F.sum("n").alias("n"), F.max("own").alias("own")).select("doc_id", "side", "own.path", "span_id", "own.start_line", "own.end_line", "own.cited", "text", "n")
    return out.where("n = end_line - start_line + 1").withColumn("citation_id", stable_id("source", "path", "side", "start_line", "end_line", "cited")).withColumn("content_hash", F.sha2("text", 256)).drop("cited", "n")


def source_check(lines: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Changed lines per side, how many differ from the snapshot, and how many lie beyond its end."""
    snap = snapshot.select("doc_id", "side", "line", F.sha2("content", 256).alias("snap_hash"))
    ends = snapshot.groupBy("doc_id", "side").agg(F.max("line").alias("last"))
    rows = lines.select("doc_id", "side", "line", "content_hash").join(snap, ["doc_id", "side", "line"], "left").join(ends, ["doc_id", "side"], "left")
    return rows.groupBy("side").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("content_hash").eqNullSafe(F.col("snap_hash"))).alias("n_wrong"), F.count_if(F.col("line") > F.coalesce("last", F.lit(0))).alias("n_beyond"))


def size(value: Column) -> Column:
    """Bytes of a struct as compact ASCII JSON with nulls."""
    return F.octet_length(ascii_json(F.to_json(value, {"ignoreNullFields": "false"}))).cast("long")


def digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def self_counting(base: Column, times: Column | int) -> Column:
    """The least n with n = base + times * (digits of n - 1): the size of a text that states its own size so often."""
    step = lambda n: base + times * (digits(n) - 1)
    n = base
    for _ in range(4):  # a size has at most 19 digits, and each step adds one digit at most once
        n = step(n)
    return n


def diagnostic(message: tuple[str, str], omitted: Column, requested: Column) -> Column:
    return size(F.struct(F.lit(0).alias("actual_bytes"), F.lit(message[0]).alias("code"), F.lit(message[1]).alias("message"), omitted.cast("long").alias("omitted_contexts"), requested.cast("long").alias("requested_bytes")))


def measured(cited: DataFrame) -> DataFrame:
    """Citations with the sizes of their JSON in full, without text, and of the omission row, and saves, what omitting them saves."""
    where = {c: F.col(c).alias(c) for c in ("content_hash", "end_line", "path", "side", "start_line")}
    again = F.struct(where["content_hash"], where["end_line"], F.lit(SOURCE_RANGE).alias("kind"), where["path"], where["side"], where["start_line"])
    one = lambda omitted, retrieval, text: F.struct(where["content_hash"], where["end_line"], F.col("citation_id").alias("id"), F.lit(omitted).alias("omitted"), where["path"], retrieval.alias("retrieval"), where["side"], where["start_line"], text.alias("text"))
    row = F.struct("citation_id", stable_id("omission", "citation_id").alias("id"), F.lit(SOURCE_CONTEXT).alias("kind"), again.alias("retrieval"))
    sized = cited.withColumns({"full": size(one(False, F.lit(None).cast("string"), F.col("text"))), "bare": size(one(True, again, F.lit(None).cast("string"))), "row": size(row)})
    return sized.withColumn("saves", F.col("full") - F.col("bare") - F.col("row") - 1)


#: The empty document: its citations, diagnostics, omissions and counts are added to this.
FRAME = '{"citations":[],"diagnostics":[],"metrics":{"evidence_bytes":0,"omitted_source_contexts":},"omissions":[]}\n'


def budget(cited: DataFrame, most: int, by: str = "doc_id") -> DataFrame:
    """Citations with omitted, and evidence_bytes and outcome of their group: fits, omitted, omitted_all or exceeded.

    Each group is a document of its own. The largest savings are omitted first,
    by (-saves, id), until the estimated size is within the budget; what is then
    too large after all loses all text. Where even that doesn't fit, everything
    is omitted and the outcome says so. Negative budgets are refused.
    """
    if most < 0:
        raise ValueError("a budget must not be negative")
    order = f"PARTITION BY {by} ORDER BY IF(saves > 0, saves, 0) DESC, citation_id"
    rows = measured(cited).selectExpr(
        "*", f"sum(full) OVER (PARTITION BY {by}) AS in_full", f"count(1) OVER (PARTITION BY {by}) AS n", f"count_if(saves > 0) OVER (PARTITION BY {by}) AS candidates", f"sum(IF(saves > 0, full - bare, 0)) OVER (PARTITION BY {by}) AS all_text",
        f"sum(IF(saves > 0, row, 0)) OVER (PARTITION BY {by}) AS all_rows", f"row_number() OVER ({order}) AS k", f"sum(saves) OVER ({order} ROWS UNBOUNDED PRECEDING) AS saved", f"sum(full - bare) OVER ({order} ROWS UNBOUNDED PRECEDING) AS text_gone", f"sum(row) OVER ({order} ROWS UNBOUNDED PRECEDING) AS rows_made",
    )
    rows = _estimated(rows, most)
    rows = rows.selectExpr("*", f"coalesce(min(IF(enough, k, NULL)) OVER (PARTITION BY {by}), candidates) AS chosen").selectExpr("*", f"max(IF(k = chosen, size, NULL)) OVER (PARTITION BY {by}) AS chosen_size")
    return _told(rows, most).select(*cited.columns, "saves", "omitted", "outcome", "evidence_bytes")


def _estimated(rows: DataFrame, most: int) -> DataFrame:
    """Sizes of a document by its totals, and with the first k citations omitted by the running sums."""
    asked = F.lit(most)
    frame = F.col("in_full") + F.col("n") - 1 + len(FRAME)
    with_omitted = lambda k, text, made, message: frame - text + made + F.greatest(k - 1, F.lit(0)) + digits(k) + diagnostic(message, k, asked)
    rows = rows.withColumn("whole", self_counting(frame + 1, 1))
    rows = rows.withColumn("floor", self_counting(with_omitted(F.col("candidates"), F.col("all_text"), F.col("all_rows"), EXCEEDED), 2)).withColumn("all_omitted", self_counting(with_omitted(F.col("candidates"), F.col("all_text"), F.col("all_rows"), OMITTED), 2))
    estimate = F.col("whole") - F.col("saved") - 1 + diagnostic(OMITTED, F.col("k"), asked) + digits(F.col("whole")) - 1 + digits(F.col("k")) - 1
    return rows.withColumn("enough", (estimate <= asked) & (F.col("saves") > 0)).withColumn("size", self_counting(with_omitted(F.col("k"), F.col("text_gone"), F.col("rows_made"), OMITTED), 2))


def _told(rows: DataFrame, most: int) -> DataFrame:
    """rows with outcome, omitted and evidence_bytes."""
    outcome = F.when(F.col("whole") <= most, "fits").when(F.col("floor") > most, "exceeded").when(F.col("chosen_size") <= most, "omitted").otherwise("omitted_all")
    told = rows.withColumn("outcome", outcome)
    omitted = F.when(F.col("outcome") == "fits", False).when(F.col("outcome") == "omitted", F.col("k") <= F.col("chosen")).otherwise(F.col("saves") > 0)
    final = F.when(F.col("outcome") == "fits", F.col("whole")).when(F.col("outcome") == "exceeded", F.col("floor")).when(F.col("outcome") == "omitted", F.col("chosen_size")).otherwise(F.col("all_omitted"))
    return told.withColumn("omitted", omitted & (F.col("saves") > 0)).withColumn("evidence_bytes", final)


def whole_budget(cited: DataFrame, most: int) -> DataFrame:
    """As budget, for one document of all citations: places and running sums are taken by ranges, totals as one row."""
    if most < 0:
        raise ValueError("a budget must not be negative")
    some = F.when(F.col("saves") > 0, F.col("saves")).otherwise(0)
    # texts stay where they are: what is ordered are sizes and the number of the row
    rows = written(cited.sparkSession, measured(cited).withColumns({"text_saved": F.col("full") - F.col("bare"), "_row": F.monotonically_increasing_id()}), "measured")
    sizes = rows.select("_row", "citation_id", "full", "row", "saves", "text_saved")
    sum_if = lambda c: F.coalesce(F.sum(F.when(F.col("saves") > 0, F.col(c))), F.lit(0))
    total = rows.agg(F.sum("full").alias("in_full"), F.count("*").alias("n"), F.count_if(F.col("saves") > 0).alias("candidates"), sum_if("text_saved").alias("all_text"), sum_if("row").alias("all_rows"))
    at = placed(sizes, [-some, F.col("citation_id")], {"saved": F.col("saves"), "text_gone": F.col("text_saved"), "rows_made": F.col("row")}, "k")
    sized = _estimated(at.crossJoin(total), most)  # one row
    sized = written(cited.sparkSession, sized, "sized")
    found = sized.agg(F.min(F.when(F.col("enough"), F.struct("k", "size"))).alias("x"), F.max(F.when(F.col("k") == F.col("candidates"), F.struct("k", "size"))).alias("y"))
    chosen = found.select(F.coalesce("x", "y").alias("z")).select(F.col("z.k").alias("chosen"), F.col("z.size").alias("chosen_size"))
    told = _told(sized.crossJoin(chosen), most).select("_row", "saves", "omitted", "outcome", "evidence_bytes")  # one row
    return rows.select("_row", *cited.columns).join(told.hint("merge"), "_row").drop("_row")


def omissions(budgeted: DataFrame) -> DataFrame:
    """Omitted citations with the hash and range by which their text can be fetched again."""
    return budgeted.where("omitted").select(stable_id("omission", "citation_id").alias("omission_id"), "citation_id", "path", "side", "start_line", "end_line", "content_hash")


def file_hashes(snapshot: DataFrame) -> DataFrame:
    """side, path, content_hash of each file of a snapshot."""
    return snapshot.groupBy("side", "path").agg(F.sha2(listed(F.array_sort(F.collect_list(F.struct("line", "content"))), "content", "\n"), 256).alias("content_hash"))


def digests(manifest: DataFrame) -> DataFrame:
    """side, n_files, digest over path, mode and content hash of the files of a manifest (side, path, mode, content_hash), in two levels."""
    row = F.concat_ws(":", F.coalesce("mode", F.lit("")), "content_hash", "path")
    return digest(manifest.select("side", row.alias("row")), ["side"], "row").withColumnRenamed("n", "n_files")
