"""The library's entry points: analyze patches, validate explanations, resolve scopes, render reports.

Evidence is a set of lazy tables; checks run when they are asked for, and
raise ValueError with what is wrong.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.schema import schema_errors
from .functions.text import byte_text, display
from .operators import citations as C
from .operators import graph as G
from .operators import ledger as L
from .operators import patch as P
from .operators import report as R
from .operators import scopes as O
from .operators import validate as V
from .operators.acquire import acquired
from .schemas import load_schema
from .sources.tables import unwritten, written

__all__ = ["Evidence", "Explanation", "analyze", "compare", "load_explanation", "load_schema", "render_report", "resolve_comparison", "resolve_repository", "validate_explanation"]
#: Errors that a message names; all of them count.
NAMED = 20


def _fail(found: DataFrame, what: str) -> None:
    rows = [tuple(r) for r in found.limit(NAMED).collect()]
    if rows:
        raise ValueError(f"{what}: {rows}")


def resolve_repository(spark: SparkSession, path: str) -> str:
    """The folder of a snapshot's tables; ValueError if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise ValueError(f"no such folder: {path}")
    return files.resolvePath(at).toString()


def resolve_comparison(spark: SparkSession, scopes: DataFrame, refs: DataFrame, commits: DataFrame, requests: DataFrame) -> DataFrame:
    """The two ends of each scope (see operators.scopes.resolved); ValueError if one can't be resolved."""
    out = O.resolved(spark, scopes, refs, commits, requests)
    _fail(out.where("error IS NOT NULL").select("id", "error"), "scopes that can't be resolved")
    return out.drop("error")


class Evidence:
    """The ledger of patches (key, patch as text or bytes) over a snapshot (side, path, content as text or bytes).

    Every record of a patch is a file; its id is key#record. budget: bytes that
    the evidence may have, beyond which source text is omitted: of each file,
    or with whole of all files together.
    """

    STORED = ("files", "hunks", "spans")

    def __init__(self, patches: DataFrame, snapshot: DataFrame, budget: int = 1_000_000, whole: bool = False):
        self.read, self.snapshot_files, self.most, self.whole = P.Patch(patches, "key", "patch"), snapshot, budget, whole
        self.graph_status, self.facts = "disabled", patches.sparkSession.createDataFrame([], G.FACT_SCHEMA)

    files = cached_property(lambda self: self.read.files.withColumns({"doc_id": F.concat_ws("#", "key", "rec"), "path": F.coalesce("new_path", "old_path")}))

    @cached_property
    def hunks(self) -> DataFrame:
        """Hunks of files that aren't nested repositories."""
        nested = f"coalesce(old_mode, '') = '{L.SUBMODULE}' OR coalesce(new_mode, '') = '{L.SUBMODULE}'"
        rows = self.read.hunks.join(self.files.where(f"NOT ({nested})").select("key", "rec", "doc_id", "path"), ["key", "rec"]).drop("key", "rec")
        return L.with_ids(rows, self.files)

    @staticmethod
    def _changed(hunks: DataFrame) -> DataFrame:
        only = F.filter("rows", lambda r: r["kind"] != "keep")
        own = ["doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id"]
        rows = hunks.select(*own, "old_start", "new_start", F.posexplode(only).alias("ordinal", "r"))
        return rows.selectExpr(*own, "CAST(ordinal AS LONG) AS ordinal", "r.kind AS side", "IF(r.kind = 'before', old_start + r.o, new_start + r.n) AS line", "r.block", "r.content", "r.content_hash", "r.no_newline")

    changed = cached_property(lambda self: self._changed(self.hunks))
    spans = cached_property(lambda self: L.replacements(L.spans(self.changed)))
    lines = cached_property(lambda self: L.line_rows(self.spans))

    @cached_property
    def units(self) -> DataFrame:
        """Units; ids of lines are made for hunks with undecodable ones only."""
        odd = self.hunks.where(F.exists("rows", lambda r: (r["kind"] != "keep") & (r["content_hash"] != F.sha2(r["content"], 256))))
        return L.units(self.files, self.hunks, L.line_rows(L.spans(self._changed(odd))))

    classes = cached_property(lambda self: L.classified(self.files, self.hunks, self.units))
    groups = cached_property(lambda self: L.groups(self.units, self.classes))

    def store(self) -> Evidence:
        """Writes files, hunks and spans once, which everything else is made of; see release."""
        for name in self.STORED:
            self.__dict__[name] = written(self.files.sparkSession, getattr(self, name), name)
        return self

    def release(self) -> None:
        """Deletes what store has written; nothing of this evidence can be read afterwards."""
        for name in self.STORED:
            if hasattr(self.__dict__.get(name), "_written_at"):
                unwritten(self.__dict__.pop(name))

    @cached_property
    def snapshot(self) -> DataFrame:
        """Lines of the changed files' sides, by file."""
        both = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("old_path").alias("path")), F.struct(F.lit("after").alias("side"), F.col("new_path").alias("path")))).alias("p")
        wanted = self.files.select("doc_id", both).select("doc_id", "p.side", "p.path").where("path IS NOT NULL")
        text = byte_text(F.col("content").cast("binary"))
        parts = F.split(text, "\n")
        whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        each = self.snapshot_files.select("side", "path", F.posexplode(whole).alias("p", "raw"))
        return wanted.join(each, ["side", "path"]).select("doc_id", "path", "side", (F.col("p") + 1).cast("long").alias("line"), display(F.col("raw")).alias("content"), F.sha2(F.encode("raw", "ISO-8859-1"), 256).alias("raw_hash"))

    citations = cached_property(lambda self: (C.whole_budget if self.whole else C.budget)(C.citations(self.spans, self.snapshot), self.most))
    references = cached_property(lambda self: self._ids([(self.citations, "citation_id"), (self.spans, "span_id"), (self.lines, "line_id"), (self.hunks, "hunk_id"), (self.units, "unit_id")]))

    @staticmethod
    def _ids(parts: list[tuple[DataFrame, str]]) -> DataFrame:
        out = None
        for df, c in parts:
            one = df.select(F.col(c).alias("ref"))
            out = one if out is None else out.unionByName(one)
        return out

    def check(self) -> Evidence:
        """Raises ValueError if a patch is unfit, ids collide, a link has no counterpart, or a changed line isn't what the snapshot has."""
        _fail(self.read.errors, "unfit patches")
        _fail(self.references.groupBy("ref").count().where("count > 1"), "ids that collide")
        _fail(L.asymmetric(self.spans), "replacements without counterpart")
        there = self.snapshot.select("doc_id", "side", "line", "raw_hash")
        _fail(self.lines.join(there, ["doc_id", "side", "line"], "left").where("NOT (content_hash <=> raw_hash)").select("path", "side", "line"), "changed lines that the snapshot doesn't have")
        return self

    def metrics(self, facts: DataFrame | None = None) -> DataFrame:
        """The 22 counts as one row; evidence_bytes is the sum over the files."""
        spark = self.files.sparkSession
        none = spark.createDataFrame([], "confidence string, kind string")
        patches = self.read.records.select(F.encode("raw", "ISO-8859-1").alias("patch"))
        one = L.metrics(self.files, self.hunks, self.spans, self.units, self.citations, none if facts is None else facts, self.groups, patches)
        each = self.citations.agg(F.max("evidence_bytes").alias("n")) if self.whole else self.citations.groupBy("doc_id").agg(F.first("evidence_bytes").alias("n"))
        size = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_bytes"))
        return one.crossJoin(size)  # one row each

    def diagnostics(self) -> DataFrame:
        """code, doc_id (null for the whole), message, requested_bytes, actual_bytes, omitted_contexts: where source text was omitted or didn't fit; or no_changes if there are none at all."""
        by = [F.lit(None).cast("string").alias("doc_id") if self.whole else F.col("doc_id")]
        code = lambda k: F.when(F.col("outcome") == "exceeded", C.EXCEEDED[k]).otherwise(C.OMITTED[k])
        told = self.citations.where("outcome <> 'fits'").groupBy(*by).agg(F.max("outcome").alias("outcome"), F.max("evidence_bytes").alias("actual_bytes"), F.count_if("omitted").alias("omitted_contexts"))
        told = told.select("doc_id", code(0).alias("code"), code(1).alias("message"), F.lit(self.most).cast("long").alias("requested_bytes"), "actual_bytes", "omitted_contexts")
        null = lambda kind, name: F.lit(None).cast(kind).alias(name)
        empty = self.files.agg(F.count("*").alias("n")).where("n = 0").select(null("string", "doc_id"), F.lit("no_changes").alias("code"), null("string", "message"), *[null("long", c) for c in ("requested_bytes", "actual_bytes", "omitted_contexts")])
        return told.unionByName(empty)

    def documents(self) -> DataFrame:
        """doc_id, document: the evidence of each file as JSON, by the schema of that name."""
        rows = lambda df, name, order, **fields: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[F.col(c).alias(k) for k, c in fields.items()]).alias("_x")))), lambda x: x["_x"]).alias(name))
        units = rows(self.units, "units", ["unit_no"], id="unit_id", kind="kind")
        spans = rows(self.spans, "spans", ["hunk_no", "span_no"], id="span_id", hunk="hunk_id", side="side", start_line="start_line", end_line="end_line", replaces="replacement_span_id", lines="line_ids")
        cited = self.citations.withColumn("text", F.when(~F.col("omitted"), F.col("text")))
        cites = rows(cited, "citations", ["side", "start_line", "citation_id"], id="citation_id", span="span_id", side="side", content_hash="content_hash", omitted="omitted", text="text")
        files = self.files.select("doc_id", F.col("doc_id").alias("id"), "path", "old_path", "new_path", "status")
        told = files.join(units, "doc_id", "left").join(spans, "doc_id", "left").join(cites, "doc_id", "left")
        listed = [F.coalesce(F.col(c), F.array().cast(told.schema[c].dataType)).alias(c) for c in ("units", "spans", "citations")]
        return told.select("doc_id", F.to_json(F.struct("id", "path", "old_path", "new_path", "status", *listed), {"ignoreNullFields": "false"}).alias("document"))

    def markdown(self) -> DataFrame:
        files = self.files.join(self.classes.select("doc_id", "classification", "confidence"), "doc_id")
        return R.evidence_markdown(files, self.units, self.hunks, self.spans, self.lines, self.citations)

    def appendix(self) -> DataFrame:
        """path, markdown of graph facts and omitted source texts."""
        return R.appendix_markdown(self.citations, self.facts)

    def overview(self, comparison: str) -> str:
        """The first page of the evidence: counts, classes, the graph's state, diagnostics."""
        return R.overview_markdown(self.metrics(self.facts), self.groups, comparison, self.graph_status, self.diagnostics()).first().markdown


def compare(before: DataFrame, after: DataFrame, context_lines: int = 3, similarity: int = 50, copies: bool = True, **options) -> Evidence:
    """Checked evidence of two snapshots (path, mode, content as text): their patches are made here, with renames and copies by similarity. options: those of analyze."""
    patches = written(before.sparkSession, acquired(before, after, context_lines, similarity, copies), "patches")
    side = lambda df, name: df.select(F.lit(name).alias("side"), "path", F.when(F.col("mode").eqNullSafe(L.SUBMODULE), F.concat(F.lit("Subproject commit "), "content", F.lit("\n"))).otherwise(F.coalesce("content", F.lit(""))).alias("content"))
    return analyze(patches.select(F.col("path").alias("key"), "patch"), side(before, "before").unionByName(side(after, "after")), **options)


def analyze(patches: DataFrame, snapshot: DataFrame, budget: int = 1_000_000, symbols: DataFrame | None = None, graph: str = "auto", whole: bool = False) -> Evidence:
    """Checked evidence; with symbols (doc_id, name, line, end_line, confidence, provenance) also its graph facts, by the mode of graph."""
    found = Evidence(patches, snapshot, budget, whole).store().check()
    if symbols is not None:
        changed = found.lines.where("side = 'after'").select("doc_id", "line").distinct()
        lengths = found.snapshot.where("side = 'after'").groupBy("doc_id").agg(F.max("line").alias("n_lines"))
        sizes = found.files.where("new_path IS NOT NULL").select("doc_id", F.col("new_path").alias("path")).join(lengths, "doc_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
        facts = G.file_facts(sizes, changed, symbols, symbols.select("doc_id").where("false"), "after")
        found.graph_status, found.facts = G.enriched(facts, graph)
    return found


@dataclass
class Explanation:
    """summary; items (group, ord and the columns of validate.item_errors, references array<string>); owners (pos, evidence_id, owner_id)."""

    summary: str
    items: DataFrame
    owners: DataFrame


def load_explanation(spark: SparkSession, path: str) -> Explanation:
    """The explanation that a JSON file holds; ValueError with every rule of its schema that is broken."""
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("k"), F.col("value").alias("body"))
    if text.count() != 1:
        raise ValueError(f"not one document: {path}")
    _fail(schema_errors(text, "k", "body", load_schema("explanation")).select("path", "error"), "no explanation")
    item = "array<struct<id: string, kind: string, title: string, before: string, after: string, absence: string, statement: string, references: array<string>, confidence: string>>"
    told = text.select(F.from_json("body", f"summary string, items {item}, owners array<struct<evidence: string, item: string>>").alias("x")).select("x.*")
    # a key that stands there with null is there
    there = lambda c: F.array_contains(F.json_object_keys("_raw"), c)
    items = text.crossJoin(told.select(F.posexplode("items").alias("p", "i")))  # one document
    items = items.withColumn("_raw", F.expr("get_json_object(body, concat('$.items[', p, ']'))"))
    items = items.select(F.col("i.id").alias("item_id"), (F.col("p") + 1).cast("long").alias("ord"), "i.kind", "i.title", "i.before", "i.after", there("before").alias("has_before"), there("after").alias("has_after"), "i.absence", "i.statement", there("statement").alias("has_statement"), "i.references", "i.confidence")
    owners = told.select(F.posexplode("owners").alias("pos", "o")).select(F.col("pos").cast("long").alias("pos"), F.col("o.evidence").alias("evidence_id"), F.col("o.item").alias("owner_id"))
    return Explanation(told.first().summary, items, owners)


def validate_explanation(evidence: Evidence, told: Explanation, references: DataFrame | None = None) -> DataFrame:
    """Coverage as one row; ValueError with every error that there is."""
    lines, spans, units = evidence.lines, evidence.spans, evidence.units
    required = lines.select(F.col("line_id").alias("evidence_id")).unionByName(units.where("kind <> 'text'").select(F.col("unit_id").alias("evidence_id")))
    ownable = required.unionByName(spans.select(F.col("span_id").alias("evidence_id")))
    owners = V.effective(told.owners, ownable)
    cited = told.items.select("item_id", F.posexplode("references").alias("pos", "citation"))
    known = evidence.references if references is None else evidence.references.unionByName(references)
    texts = told.items.select(F.col("item_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "statement", "before", "after")])).alias("f")).select("id", "f.*").where("value IS NOT NULL")
    spark = told.items.sparkSession
    whole = spark.createDataFrame([("$", told.summary, units.limit(1).count(), told.items.limit(1).count())], "id string, summary string, n_units long, n_items long")
    summary = whole.select("id", F.lit("summary").alias("field"), F.col("summary").alias("value")).where("value IS NOT NULL")
    row = lambda df, at, error: df.select(F.col(at).cast("string").alias("at"), (F.col(error) if error in df.columns else F.lit(error)).cast("string").alias("error"))
    parts = [
        row(V.item_errors(told.items), "item_id", "error"), row(V.policy_errors(texts.unionByName(summary)), "id", "intent"), row(V.forbidden_kinds(told.items), "item_id", "judging kind"),
        row(V.repeated_ids(told.items.select(F.col("item_id").alias("id"), F.lit("item").alias("kind"), F.col("ord").cast("string").alias("path"))), "id", "item id is repeated"),
        row(V.owner_errors(told.owners, ownable, told.items), "evidence_id", "error"), row(V.missing(required, owners), "evidence_id", "no owner"), row(V.duplicates(told.owners), "evidence_id", "several owner entries"),
        row(V.span_owner(lines, owners).where("error IS NOT NULL"), "span_id", "error"), row(V.citation_errors(cited, known), "item_id", "error"), row(V.summary_errors(whole), "id", "error"),
    ]
    errors = parts[0]
    for p in parts[1:]:
        errors = errors.unionByName(p)
    _fail(errors, "the explanation is not valid")
    return V.coverage(lines, owners, units, cited)


def render_report(evidence: Evidence, told: Explanation) -> str:
    """Markdown of a valid explanation's report."""
    cover = validate_explanation(evidence, told).withColumn("group", F.lit(0))
    items = told.items.withColumn("group", F.lit(0))
    report = items.sparkSession.createDataFrame([(0, told.summary)], "group int, summary string")
    return R.report_markdown(report, items, cover, told.owners.select(F.lit(0).alias("group"), "evidence_id", "owner_id")).first().markdown
