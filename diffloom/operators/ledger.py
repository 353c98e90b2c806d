"""Hunks, spans, lines, units, classes, groups and metrics of a change ledger.

A hunk row carries its lines as an array, a span row its members, so that the
ids chain from file to hunk, span and line without a join: an id hashes the
ids above it. Tables that meet by file are merged, as they lie by file already,
and never sent to the driver. All of it runs in the partitions that hold the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_of, parts_of, stable_id, suffix_of
from ..functions.text import BLANK, let

#: Names, suffixes and parts of paths that classify a file.
LOCKFILES = ["cargo.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock"]
DEPENDENCIES = ["cargo.toml", "package.json", "pyproject.toml", "requirements.txt", "go.mod", "go.sum"]
CONFIG_NAMES = [".editorconfig", ".gitattributes", ".gitignore", "compose.yaml", "compose.yml", "dockerfile", "makefile", "tox.ini"]
CONFIG_SUFFIXES = [".ini", ".toml", ".yaml", ".yml"]
SCHEMA_SUFFIXES = [".json", ".yaml", ".yml", ".graphql"]
DOC_SUFFIXES = [".md", ".rst", ".adoc"]
SOURCE_SUFFIXES = [".c", ".cc", ".cpp", ".go", ".java", ".js", ".jsx", ".php", ".py", ".rb", ".rs", ".ts", ".tsx"]
#: The mode of a nested repository, and the text that stands for a missing line feed.
SUBMODULE, MARKER = "160000", "\\ No newline at end of file"
IDENTITY = ("old_path", "new_path", "old_blob", "new_blob", "old_mode", "new_mode", "status")


def listed(rows: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(rows, lambda x: x[field]), sep)


def together(by: str, first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of several tables under one another, with null where a table lacks a column, of the keys that all of them have.

    They are packed to a row for each key and unpacked behind a merge by the key
    alone: tables that lie by it aren't shuffled, neither here nor where the
    rows are then grouped by it and others. A join by it and others, or a union, would.
    """
    types = {f.name: f.dataType for t in (first, *others) for f in t.schema.fields if f.name != by}
    column = lambda t, c: F.col(c).cast(types[c]) if c in t.columns else F.lit(None).cast(types[c])
    packed = [t.groupBy(by).agg(F.collect_list(F.struct(*[column(t, c).alias(c) for c in types])).alias(f"_{k}")) for k, t in enumerate((first, *others))]
    rows = packed[0]
    for other in packed[1:]:
        rows = rows.join(other.hint("merge"), by)
    return rows.select(by, F.explode(F.concat(*[f"_{k}" for k in range(len(packed))])).alias("_x")).select(by, "_x.*")


def of_range(start: Column, count: Column) -> Column:
    return F.concat(start.cast("string"), F.when(count == 1, "").otherwise(F.concat(F.lit(","), count.cast("string"))))


def hunks(hunk_lines: DataFrame, files: DataFrame, heading: Column | None = None) -> DataFrame:
    """One row a hunk: ranges with context, rows (its lines in order), raw text, ids of the hunk and of its text unit. heading: by default the hunk's number."""
    rows = hunk_lines.groupBy("doc_id", "path", "hunk_no").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "old_line", "new_line", "block", "content", "no_newline"))).alias("rows"))
    side = lambda other: F.filter("rows", lambda x: x["kind"] != other)
    start = lambda part, field: F.coalesce(F.get(part, F.lit(0))[field], F.col("rows")[0][field])
    sized = rows.select(
        "*", start(side("after"), "old_line").alias("old_start"), F.size(side("after")).cast("long").alias("old_count"), start(side("before"), "new_line").alias("new_start"), F.size(side("before")).cast("long").alias("new_count"),
        F.size(F.array_distinct(F.transform(F.filter("rows", lambda x: x["kind"] != "keep"), lambda x: x["block"]))).cast("long").alias("n_blocks"), (F.concat(F.lit("section "), "hunk_no") if heading is None else heading).alias("heading"),
    )
    mark = lambda x: F.when(x["kind"] == "keep", " ").when(x["kind"] == "before", "-").otherwise("+")
    text = F.transform("rows", lambda x: F.concat(mark(x), x["content"], F.lit("\n"), F.when(x["no_newline"], F.lit(MARKER + "\n")).otherwise("")))
    head = F.concat(F.lit("@@ -"), of_range(F.col("old_start"), F.col("old_count")), F.lit(" +"), of_range(F.col("new_start"), F.col("new_count")), F.lit(" @@"), F.when(F.col("heading") == "", "").otherwise(F.concat(F.lit(" "), "heading")), F.lit("\n"))
    raw = sized.withColumn("raw", F.concat(head, F.array_join(text, "")))
    return with_ids(raw.withColumn("patch_hash", F.sha2("raw", 256)).withColumn("raw_patch_bytes", F.octet_length("raw").cast("long")), files)


def with_ids(hunks_: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_hash (of all hunks of the file), unit_id and hunk_id to hunks (doc_id, hunk_no, ranges, patch_hash)."""
    every = F.expr("transform(array_sort(collect_list(struct(hunk_no, patch_hash)) OVER (PARTITION BY doc_id)), x -> x.patch_hash)")
    keyed = hunks_.withColumn("file_hash", F.sha2(F.array_join(every, ","), 256)).join(files.select("doc_id", *IDENTITY).hint("merge"), "doc_id")
    ids = keyed.withColumn("unit_id", stable_id("unit", *IDENTITY, F.lit("text"), "file_hash")).withColumn("hunk_id", stable_id("hunk", "old_path", "new_path", "old_blob", "new_blob", "status", "old_start", "old_count", "new_start", "new_count", "patch_hash"))
    return ids.drop("old_blob", "new_blob", "old_mode", "new_mode", "status")


def changed(hunks_: DataFrame) -> DataFrame:
    """Changed lines of hunks: side, line, block, ordinal (among the changed ones), content, content_hash, no_newline, with the hunk's and the unit's id."""
    only = F.filter("rows", lambda x: x["kind"] != "keep")
    row = hunks_.select("doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id", F.posexplode(only).alias("ordinal", "x"))
    return row.selectExpr("doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id", "CAST(ordinal AS LONG) AS ordinal", "x.kind AS side", "IF(x.kind = 'before', x.old_line, x.new_line) AS line", "x.block", "x.content", "sha2(x.content, 256) AS content_hash", "x.no_newline")


def spans(lines: DataFrame) -> DataFrame:
    """Gaps and islands: runs of one block and side with consecutive lines, one row each with its members in order and its id."""
    order = "PARTITION BY doc_id, hunk_no ORDER BY ordinal"
    broken = lines.selectExpr("*", f"IF(lag(block) OVER ({order}) = block AND lag(side) OVER ({order}) = side AND lag(line) OVER ({order}) = line - 1, 0L, 1L) AS cut")
    island = broken.selectExpr("*", f"sum(cut) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS span_no")
    own = ("doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id", "span_no", "block", "side")
    rows = island.groupBy(*own).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("ordinal", "line", "content", "content_hash", "no_newline"))).alias("members"))
    inside = F.array_join(F.transform("members", lambda x: F.concat_ws(":", x["line"], x["ordinal"], x["content_hash"])), ",")
    named = rows.withColumn("span_id", stable_id("span", "unit_id", "hunk_id", "side", "start_line", "end_line", "span_no", inside))
    line_id = lambda x: stable_id("line", "unit_id", "hunk_id", "span_id", "side", x["line"], x["ordinal"], x["content_hash"], x["no_newline"])
    return named.withColumn("line_ids", F.transform("members", line_id))


def replacements(spans_: DataFrame) -> DataFrame:
    """Spans with replacement_span_id: adjacent before and after spans of one block point at each other."""
    order = "OVER (PARTITION BY doc_id, hunk_no ORDER BY span_no)"
    beside = spans_.selectExpr("*", *[f"{f}({c}) {order} AS {f}_{c}" for f in ("lag", "lead") for c in ("block", "side", "span_id")])
    link = "CASE WHEN side = 'before' AND lead_block = block AND lead_side = 'after' THEN lead_span_id WHEN side = 'after' AND lag_block = block AND lag_side = 'before' THEN lag_span_id END"
    return beside.selectExpr(*spans_.columns, f"{link} AS replacement_span_id")


def line_rows(spans_: DataFrame) -> DataFrame:
    """The changed lines with the ids of unit, hunk, span and line."""
    own = ["doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id", "span_id", "span_no", "block", "side"]
    return spans_.select(*own, F.explode(F.arrays_zip("members", "line_ids")).alias("x")).select(*own, "x.members.*", F.col("x.line_ids").alias("line_id"))


def asymmetric(spans_: DataFrame) -> DataFrame:
    """Spans whose replacement is missing, on the same side, or points elsewhere."""
    other = spans_.select(F.col("span_id").alias("replacement_span_id"), F.col("side").alias("other_side"), F.col("replacement_span_id").alias("back"))
    both = spans_.where("replacement_span_id IS NOT NULL").select("span_id", "side", "replacement_span_id").join(other, "replacement_span_id", "left")
    return both.where("other_side IS NULL OR other_side = side OR NOT (back <=> span_id)").select("span_id", "replacement_span_id")


def undecodable(lines: DataFrame) -> DataFrame:
    """doc_id, undecodable_line_ids: lines whose bytes are no UTF-8, in order; what is shown of them differs from what is hashed."""
    bad = lines.where(F.col("content_hash") != F.sha2("content", 256))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "ordinal", "line_id"))), lambda x: x["line_id"])
    return bad.groupBy("doc_id").agg(ids.alias("undecodable_line_ids"))


def units(files: DataFrame, hunks_: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Change units in order: text where there are hunks, then non-text ones by the file's facts; unsupported where nothing else is.

    A nested repository has no text unit. metadata: the unit's facts as JSON;
    with lines (line_rows) of hunks from bytes also the ids of undecodable ones.
    """
    text = hunks_.groupBy("doc_id").agg(F.first("file_hash").alias("file_hash"), F.sort_array(F.collect_list(F.when(F.exists("rows", lambda x: x["no_newline"]), F.col("hunk_id"))), True).alias("open_hunks"))
    rows = files.select("doc_id", "path", "binary", "similarity" if "similarity" in files.columns else F.lit(None).cast("string").alias("similarity"), *IDENTITY).join(text.hint("merge"), "doc_id", "left")
    rows = rows.withColumn("undecodable_line_ids", F.lit(None).cast("array<string>")) if lines is None else rows.join(undecodable(lines).hint("merge"), "doc_id", "left")
    nested = (F.coalesce("old_mode", F.lit("")) == SUBMODULE) | (F.coalesce("new_mode", F.lit("")) == SUBMODULE)
    fact = lambda kind, *names: F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("metadata"))
    kinds = [
        F.when(F.col("file_hash").isNotNull() & ~nested, F.struct(F.lit("text").alias("kind"), F.to_json(F.struct(F.when(F.size("open_hunks") > 0, F.col("open_hunks")).alias("no_newline"), "undecodable_line_ids")).alias("metadata"))),
        F.when(F.col("binary"), F.struct(F.lit("binary").alias("kind"), F.lit('{"binary":true}').alias("metadata"))),
        F.when(~F.col("old_mode").eqNullSafe(F.col("new_mode")), fact("mode", "new_mode", "old_mode")),
        F.when(F.col("status") == "renamed", fact("rename", "new_path", "old_path")),
        F.when(F.col("status") == "copied", fact("copy", "new_path", "old_path")),
        F.when(nested, fact("submodule", F.col("new_blob").alias("new_object"), F.col("old_blob").alias("old_object"))),
    ]
    some = F.filter(F.array(*kinds), lambda k: k.isNotNull())
    none = F.array(fact("unsupported", *sorted(IDENTITY)))
    each = rows.select("doc_id", "path", "file_hash", *IDENTITY, F.posexplode(F.when(F.size(some) > 0, some).otherwise(none)).alias("unit_no", "x")).select("doc_id", "path", "file_hash", *IDENTITY, (F.col("unit_no") + 1).cast("long").alias("unit_no"), "x.*")
    return each.withColumn("unit_id", stable_id("unit", *IDENTITY, "kind", F.when(F.col("kind") == "text", F.col("file_hash")))).drop("file_hash")


def classification(path: Column, status: Column, kinds: Column, has_hunks: Column, formatting: Column) -> tuple[Column, Column]:
    """(class, confidence) by the first rule that holds."""
    name, end, parts = F.lower(name_of(path)), suffix_of(path), F.transform(parts_of(path), F.lower)
    has = lambda kind: F.array_contains(kinds, kind)
    within = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    first = [
        (has("unsupported"), "unsupported"), (has("binary"), "binary"), (has("rename"), "rename"), (status == "added", "added"), (status == "deleted", "deleted"),
        ((F.size(kinds) == 1) & has("mode"), "mode"), (~has_hunks, "structural"), (name.isin(LOCKFILES + DEPENDENCIES), "dependency"),
    ]
    rest = [
        (within("generated") | name.endswith(".min.js") | name.endswith(".min.css"), "generated"),
        ((end == ".schema") | within("schema") | (name.contains("schema") & end.isin(SCHEMA_SUFFIXES)), "schema"),
        (name.isin(CONFIG_NAMES) | within(".github") | end.isin(CONFIG_SUFFIXES) | (name.startswith(".") & name.endswith("rc")), "configuration"),
        (within("test", "tests") | name.startswith("test_") | name.contains(".test."), "tests"),
        (within("docs") | end.isin(DOC_SUFFIXES), "docs"),
        (formatting, "formatting"), (end.isin(SOURCE_SUFFIXES), "behavioral"),
    ]
    choose = lambda pairs, last: F.coalesce(*[F.when(holds, F.lit(value)) for holds, value in pairs], F.lit(last))
    return choose([*first, *rest], "unresolved"), choose([*((c, "extracted") for c, _ in first), *((c, "inferred") for c, _ in rest)], "unresolved")


def formatting_only(hunks_: DataFrame) -> DataFrame:
    """doc_id, formatting: both sides changed, unequal, and equal without white space."""
    text = lambda side: F.transform(F.filter("rows", lambda x: x["kind"] == side), lambda x: x["content"])
    parts = hunks_.select("doc_id", "hunk_no", text("before").alias("b"), text("after").alias("a"))
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", c))), lambda x: x[c])).alias(c)
    rows = parts.groupBy("doc_id").agg(whole("b"), whole("a"))
    bare = lambda c: F.regexp_replace(F.array_join(c, "\n"), BLANK, "")
    return rows.select("doc_id", ((F.size("b") > 0) & (F.size("a") > 0) & (F.array_join("b", "\n") != F.array_join("a", "\n")) & (bare("b") == bare("a"))).alias("formatting"))


def classified(files: DataFrame, hunks_: DataFrame, units_: DataFrame) -> DataFrame:
    kinds = units_.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    rows = files.select("doc_id", "path", *[c for c in ("source",) if c in files.columns], "old_path", "new_path", "status").join(kinds.hint("merge"), "doc_id").join(formatting_only(hunks_).hint("merge"), "doc_id", "left")
    text = F.array_contains("kinds", "text")
    kind, sure = classification(F.coalesce("new_path", "old_path", F.lit("")), F.col("status"), F.col("kinds"), text, F.coalesce("formatting", F.lit(False)))
    return rows.withColumn("classification", kind).withColumn("confidence", sure).drop("kinds", "formatting")


def groups(units_: DataFrame, classes: DataFrame, buckets: int = 256) -> DataFrame:
    """Units by class; binary, mode, rename and unsupported units keep their kind, copies and nested repositories are structural.

    units_hash is a digest of two levels: ids in order within each of some
    hash buckets, then the buckets in order, so that no task lists a whole class.
    """
    kind = F.when(F.col("kind").isin("binary", "mode", "rename", "unsupported"), F.col("kind")).when(F.col("kind").isin("copy", "submodule"), "structural").otherwise(F.col("classification"))
    rows = units_.join(classes.select("doc_id", "classification").hint("merge"), "doc_id").select(kind.alias("group_class"), "unit_id")
    return digest(rows, ["group_class"], "unit_id", buckets).withColumnsRenamed({"n": "n_units", "digest": "units_hash"}).withColumn("group_id", stable_id("group", "group_class"))


def digest(rows: DataFrame, by: list[str], value: str, buckets: int = 256) -> DataFrame:
    """by, n, digest over the values in order, in two levels: the first two hex digits of each value's hash give its bucket."""
    bucket = F.conv(F.substring(F.sha2(value, 256), 1, 4), 16, 10).cast("int") % buckets
    inner = rows.withColumn("_b", bucket).groupBy(*by, "_b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256).alias("h"))
    return inner.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def metrics(files: DataFrame, hunks_: DataFrame, spans_: DataFrame, units_: DataFrame, citations: DataFrame, facts: DataFrame, groups_: DataFrame, patches: DataFrame) -> DataFrame:
    """One row of counts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    both = lambda side: total(F.when(F.col("side") == side, F.col("n_lines")).otherwise(0))
    parts = [
        files.agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("added", "deleted", "renamed")]),
        units_.agg(F.count("*").alias("units"), F.count_if(F.col("kind") == "binary").alias("binary_units"), F.count_if(F.col("kind") == "unsupported").alias("unsupported_units")),
        hunks_.agg(F.count("*").alias("hunks")),
        spans_.agg(F.count("*").alias("spans"), both("after").alias("added_lines"), both("before").alias("deleted_lines"), total("n_lines").alias("changed_lines")),
        citations.agg(F.count("*").alias("source_citations"), F.count_if("omitted").alias("omitted_source_contexts")),
        facts.agg(F.count("*").alias("graph_facts"), F.count_if(F.col("confidence").isin("unresolved", "unavailable") | (F.col("kind") == "unsupported")).alias("unresolved_graph_facts")),
        groups_.agg(F.count("*").alias("classification_groups")),
        patches.agg(total(F.octet_length("patch")).alias("raw_patch_bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.selectExpr("*", "1.0D AS line_coverage_ratio", "1.0D AS hunk_coverage_ratio", "1.0D AS unit_coverage_ratio")


def files_in_order(files: DataFrame) -> DataFrame:
    """Files by path (after, else before) and status, range-partitioned, so that no task sorts all."""
    return files.withColumn("at", F.coalesce("new_path", "old_path", F.lit(""))).orderBy("at", "status")
