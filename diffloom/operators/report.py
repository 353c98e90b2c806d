"""Reports and evidence as Markdown and JSON, and checks of texts against a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from .ledger import listed, together

#: Sections of a report in order, and their titles.
SECTIONS = {"behavioral": "Behavioral before to after", "structural": "Structural and non-behavioral changes", "observer": "Who observes the changes", "ambiguity": "Ambiguity and unresolved notes"}
GUARANTEE = "Accounting and citation references were verified; semantic correctness was not."
NONE = "_None._"


def lines(*parts) -> Column:
    """Lines of text; null parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def ordered(rows, order: list[str], text: Column, sep: str = "\n") -> Column:
    return listed(F.array_sort(F.collect_list(F.struct(*order, text.alias("text")))), "text", sep)


def evidence_markdown(files: DataFrame, units: DataFrame, hunks: DataFrame, spans: DataFrame, lines_: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, markdown of each file of a ledger: status and class, units, hunks with spans and lines, citations. spans have replacement_span_id."""
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    replaced = F.when(F.col("replacement_span_id").isNotNull(), F.concat(F.lit("; replaces "), tick("replacement_span_id"))).otherwise("")
    owned = F.array_join(F.transform("line_ids", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    span = F.concat(F.lit("- "), tick("span_id"), F.lit(" — "), "side", F.lit(" "), "start_line", F.lit("-"), "end_line", F.lit("; lines "), owned, replaced)
    diff = F.concat(F.when(F.col("side") == "before", "-").otherwise("+"), "content")
    told = F.concat(F.lit("- "), tick("line_id"), F.lit(" — "), "side", F.lit(" line "), "line", F.lit(" (ordinal "), "ordinal", F.lit(")"))
    head = F.concat(F.lit("##### Hunk "), tick("hunk_id"), F.lit(" (-"), "old_start", F.lit(","), "old_count", F.lit(" +"), "new_start", F.lit(","), "new_count", F.lit(")"))
    own = [hunks.select("doc_id", "hunk_id", "hunk_no", head.alias("head")), spans.select("doc_id", "hunk_id", F.struct("span_no", span.alias("text")).alias("span")), lines_.select("doc_id", "hunk_id", F.struct("ordinal", diff.alias("diff"), told.alias("text")).alias("line"))]
    per = together("doc_id", *own).groupBy("doc_id", "hunk_id").agg(F.max("hunk_no").alias("hunk_no"), F.max("head").alias("head"), F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("line")).alias("lines"))
    hunk_rows = per.where("head IS NOT NULL AND size(spans) > 0 AND size(lines) > 0").select("doc_id", "hunk_no", "head", listed(F.col("spans"), "text", "\n").alias("span_text"), listed(F.col("lines"), "diff", "\n").alias("diff"), listed(F.col("lines"), "text", "\n").alias("line_text"))
    hunk = lines(F.col("head"), "", "Spans:", F.col("span_text"), "", "```diff", F.col("diff"), "```", "", "Changed lines:", F.col("line_text"), "")
    hunk_text = hunk_rows.groupBy("doc_id").agg(ordered(hunk_rows, ["hunk_no"], hunk).alias("hunk_text"))
    unit = lines(F.concat(F.lit("#### Unit "), tick("unit_id"), F.lit(" ("), "kind", F.lit(")")), "", F.when(F.col("metadata") != "{}", F.concat(F.lit("Metadata: `"), "metadata", F.lit("`\n"))), F.when(F.col("kind") == "text", F.col("hunk_text")).otherwise("Textual hunks: none.\n"))
    unit_rows = units.select("doc_id", "unit_no", "unit_id", "kind", "metadata").join(hunk_text.hint("merge"), "doc_id", "left")
    unit_text = unit_rows.groupBy("doc_id").agg(ordered(unit_rows, ["unit_no"], unit).alias("unit_text"))
    state = F.when(F.col("omitted"), "omitted; retrieval retained").otherwise("included")
    cite = F.concat(F.lit("- "), tick("citation_id"), F.lit(" — "), tick("path"), F.lit(" "), "side", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(" ("), state, F.lit(", sha256 "), tick("content_hash"), F.lit(")"))
    cited = citations.groupBy("doc_id").agg(ordered(citations, ["side", "start_line", "citation_id"], cite).alias("cite_text"))
    rows = files.join(unit_text.hint("merge"), "doc_id").join(cited.hint("merge"), "doc_id", "left")
    status = F.concat(F.lit("Status: "), "status", F.lit(" · Classification: "), "classification", F.lit(" ("), "confidence", F.lit(")"))
    return rows.select("doc_id", lines(F.concat(F.lit("### `"), F.coalesce("new_path", "old_path"), F.lit("`")), "", status, "", F.col("unit_text"), F.when(F.col("cite_text").isNotNull(), lines("#### Source citations", "", F.col("cite_text"), ""))).alias("markdown"))


def appendix_markdown(citations: DataFrame, facts: DataFrame) -> DataFrame:
    """path, markdown of what stands behind the files: their graph facts by line, kind and id, and how omitted texts are found again. Facts of no path come under an empty one."""
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    at = F.when(F.col("line").isNotNull(), F.concat("path", F.lit(":"), "line")).when(F.col("path") != "", F.col("path")).otherwise("unresolved location")
    fact = F.concat(F.lit("- "), tick("fact_id"), F.lit(" "), "kind", F.lit(" "), F.coalesce("symbol", F.lit("")), F.lit(" at `"), at, F.lit("` ("), "confidence", F.lit("; "), "provenance", F.lit(")"))
    told = facts.withColumns({"path": F.coalesce("path", F.lit("")), "_at": F.coalesce("line", F.lit(0))})
    known = told.groupBy("path").agg(ordered(told, ["side", "_at", "kind", "fact_id"], fact).alias("fact_text"))
    gone = citations.where("omitted")
    row = F.concat(F.lit("- "), tick("citation_id"), F.lit(" — retrieve "), tick("path"), F.lit(" "), "side", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(" (sha256 "), tick("content_hash"), F.lit(")"))
    omitted = gone.groupBy("path").agg(ordered(gone, ["side", "start_line", "citation_id"], row).alias("gone_text"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), lines(f"#### {title}", "", F.col(c), ""))
    return known.join(omitted.hint("merge"), "path", "full").select("path", lines(part("Structural enrichment", "fact_text"), part("Omitted source context", "gone_text")).alias("markdown"))


def overview_markdown(metrics: DataFrame, groups: DataFrame, comparison: str, status: str = "disabled", diagnostics: DataFrame | None = None) -> DataFrame:
    """markdown, one row: what is compared, the counts (of metrics), the groups by class, the state of the graph and diagnostics (code, doc_id, message).

    Diagnostics are counted by code and message, so the page has as many lines as there are classes and codes.
    """
    counts = [("files", "files"), ("units", "units"), ("hunks", "hunks"), ("spans", "spans"), ("added_lines", "added lines"), ("deleted_lines", "deleted lines")]
    told = F.concat_ws(" · ", *[F.concat(F.col(c).cast("string"), F.lit(f" {name}")) for c, name in counts])
    each = F.concat(F.lit("- "), "group_class", F.lit(": "), "n_units", F.lit(" units (`"), "group_id", F.lit("`)"))
    page = metrics.crossJoin(groups.agg(ordered(groups, ["group_class"], each).alias("group_text")))  # one row each
    noted = F.lit(None).cast("string")
    if diagnostics is not None:
        by = diagnostics.groupBy("code", F.coalesce("message", F.lit("")).alias("message")).agg(F.count("doc_id").alias("n"))
        row = F.concat(F.lit("- **"), "code", F.lit("**: "), "message", F.when(F.col("n") > 0, F.concat(F.lit(" ("), "n", F.lit(" files)"))).otherwise(""))
        page, noted = page.crossJoin(by.agg(ordered(by, ["code", "message"], row).alias("noted"))), F.col("noted")  # one row
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return page.select(
        lines(
            "# Evidence", "", f"Comparison: `{comparison}`", "", "## Change ledger", "", told, "", F.when(F.col("files") == 0, "**No changes are present in this comparison.**\n"),
            F.when(some(F.col("group_text")), lines("## Classes", "", F.col("group_text"), "")), "## Structural enrichment", "", F.concat(F.lit(f"Graph: **{status}**, "), F.col("graph_facts").cast("string"), F.lit(" facts\n")),
            F.when(some(noted), lines("## Diagnostics", "", noted, "")),
        ).alias("markdown")
    )


def sections(items: DataFrame) -> DataFrame:
    """Items (item_id, kind, group, ord) routed to report sections, numbered in input order within their group; unresolved ones go with ambiguities."""
    section = F.when(F.col("kind") == "unresolved", "ambiguity").otherwise(F.col("kind"))
    return items.select("group", "item_id", section.alias("section"), "ord").selectExpr("group", "section", "CAST(row_number() OVER (PARTITION BY group, section ORDER BY ord, item_id) AS LONG) AS position", "item_id")


def item_markdown(items: DataFrame) -> DataFrame:
    """Items (item_id, title, before, after, has_before, has_after, absence, statement, references array, confidence) with markdown."""
    side = lambda s: F.when(F.coalesce(F.col("absence") == s, F.lit(False)), "Absent").otherwise(F.coalesce(F.col(s), F.lit("")))
    both = F.when(F.col("has_before") & F.col("has_after"), lines(F.concat(F.lit("**Before:** "), side("before")), "", F.concat(F.lit("**After:** "), side("after")), ""))
    told = F.when(F.coalesce(F.col("statement"), F.lit("")) != "", F.concat("statement", F.lit("\n")))
    refs = F.when(F.size("references") > 0, F.concat(F.lit("Evidence: "), F.array_join(F.transform("references", lambda r: F.concat(F.lit("`"), r, F.lit("`"))), ", "), F.lit("\n")))
    return items.withColumn("markdown", lines(F.concat(F.lit("### "), "title"), "", both, told, refs, F.concat(F.lit("Confidence: **"), "confidence", F.lit("**\n"))))


def percent(ratio: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("long").cast("string"), F.lit("%"))


def report_markdown(reports: DataFrame, items: DataFrame, coverage: DataFrame, owners: DataFrame) -> DataFrame:
    """group, markdown of reports (group, summary) with their items, coverage (line_owned ... citation_count) and direct owners (evidence_id, owner_id): sections in a fixed order."""
    placed = item_markdown(items).join(sections(items).select("group", "item_id", "section", "position"), ["group", "item_id"])
    per = placed.groupBy("group").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("position", "markdown")))), lambda x: x["markdown"]), "\n").alias(s) for s in SECTIONS])
    owned = owners.groupBy("group").agg(ordered(owners, ["evidence_id", "owner_id"], F.concat(F.lit("| `"), "evidence_id", F.lit("` | `"), "owner_id", F.lit("` |"))).alias("owner_text"))
    rows = reports.join(per, "group", "left").join(coverage, "group").join(owned, "group", "left")
    part = lambda s: lines(f"## {SECTIONS[s]}", "", F.when(F.coalesce(F.col(s), F.lit("")) == "", NONE + "\n").otherwise(F.col(s)))
    share = lambda label, k: F.concat(F.lit(f"- {label}: "), f"{k}_owned", F.lit("/"), f"{k}_total", F.lit(" ("), percent(F.col(f"{k}_ratio")), F.lit(")"))
    body = lines(
        "# Explanation", "", F.col("summary"), "", *[part(s) for s in SECTIONS], "## Complete source-cited coverage appendix", "",
        share("Changed lines", "line"), share("Change spans", "span"), share("Textual hunks", "hunk"), share("Change units", "unit"), F.concat(F.lit("- Valid citation references: "), "citation_count"), "",
        "Spans without a direct entry inherit the unanimous owner of their changed lines.", "", "| Directly owned evidence | Coverage owner |", "|---|---|", F.col("owner_text"), "", f"> {GUARANTEE}", "",
    )
    return rows.select("group", body.alias("markdown"))


def report_json(reports: DataFrame, items: DataFrame, coverage: DataFrame, owners: DataFrame) -> DataFrame:
    """group, json: the report as one line of canonical JSON."""
    per = sections(items).groupBy("group").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("position", "item_id")))), lambda x: x["item_id"]).alias(s) for s in SECTIONS])
    owned = owners.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "owner_id"))), lambda x: x).alias("coverage_owners"))
    rows = reports.join(per, "group", "left").join(coverage, "group").join(owned, "group", "left")
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    counts = sorted([f"{k}_{x}" for k in ("line", "span", "hunk", "unit") for x in ("owned", "ratio", "total")] + ["citation_count"])
    body = F.struct(F.struct(*[F.col(c) for c in counts]).alias("coverage"), "coverage_owners", F.lit(GUARANTEE).alias("guarantee"), F.struct(*[some(s).alias(s) for s in sorted(SECTIONS)]).alias("sections"), "summary")
    return rows.select("group", canonical_json(body).alias("json"))


def assertions(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (assertion_id, doc_id, side, test: exists, contains or lacks, needle, expected) against texts (doc_id, side, text): pass or fail; skip where test is null.

    A file that is missing contains nothing and lacks everything.
    """
    rows = wanted.join(texts, ["doc_id", "side"], "left")
    there, found = F.col("text").isNotNull(), F.coalesce(F.contains("text", "needle"), F.lit(False))
    passed = F.when(F.col("test") == "exists", there == F.col("expected")).when(F.col("test") == "contains", there & found).when(F.col("test") == "lacks", ~there | ~found)
    return rows.select("assertion_id", "doc_id", "side", F.when(passed.isNull(), "skip").when(passed, "pass").otherwise("fail").alias("status"))
