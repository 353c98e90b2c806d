"""Queries over explanations: items, owners, citations, policy, coverage, reports.

Items are the turns of conversations with their whole text; what they declare
follows from their numbers. Every conversation is an explanation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.schema import schema_errors
from ..functions.text import canonical_json
from ..operators import ledger as L
from ..operators import release as X
from ..operators import report as R
from ..operators import validate as V
from .base import BASE, quote

#: Sentences of ours that are put behind texts: some that the policy rejects, some that it does not.
SENTENCES = [
    "", "Severity: high", "This change presents a medium risk in loops.", "The risk was rated high; severity is low.", "The patch introduces a bug in parsing.", "New defects are introduced here.", "The bugs were found later.",
    "It has a slow parser bug that remains.", "The change leaks tokens to the log.", "We recommend another name.", "The list must be rewritten.", "Code review found it.", "The parser now keeps blank lines.", "The flag `severity is high` is renamed.", "Callers receive a list.", "It probably works.", 'It "probably" works.', "It may work in May.", "May fail to load.", "May is a month.",
]
TITLES = ["Parser keeps blank lines", "Bugs", "Review findings", "Race condition defect.", "", "Faster joins"]
FIELDS = ["title", "Severity", "statement", "risk", "recommended-fix", "verdict", "summary", "priority", "Review-Findings"]
KINDS = ["behavioral", "structural", "observer", "ambiguity", "unresolved", "Finding"]
SUMMARIES = ["Nothing happened.", "No changes.", "Both sides are identical.", "", "All unchanged"]
SCHEMA = {
    "type": "object", "required": ["id", "kind", "citations"], "additionalProperties": False,
    "properties": {"id": {"type": "string", "minLength": 3}, "kind": {"enum": V.KINDS}, "citations": {"type": "array", "minItems": 1, "items": {"oneOf": [{"type": "string", "pattern": "^[a-z]"}, {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string"}}}]}}, "turn": {"type": "integer", "minimum": 0, "maximum": 3}, "before": {"type": ["string", "null"]}},
    "if": {"properties": {"kind": {"const": "behavioral"}}}, "then": {"required": ["before"]},
}

pick = lambda by, names: f"element_at(array({', '.join('NULL' if n is None else quote(n).replace(chr(92), chr(92) * 2) for n in names)}), CAST(({by}) % {len(names)} AS INT) + 1)"
choose = lambda by, names: f"CASE CAST(({by}) % {len(names)} AS INTEGER) " + " ".join(f"WHEN {k} THEN {'NULL' if n is None else quote(n)}" for k, n in enumerate(names)) + " END"
#: Columns of an item by engine: the pattern is the same, the way to pick from a list differs.
_columns = lambda p: [
    ("ord", "conv_id * 100 + turn"), ("group", "conv_id"), ("item_id", "concat('i', conv_id, '_', turn)"), ("kind", p("conv_id + turn", KINDS)), ("title", p("conv_id * 3 + turn", TITLES)),
    ("before", p("conv_id", ["old", "old", None, " "])), ("after", p("turn + conv_id", ["new", None, "new"])), ("has_before", "conv_id % 5 <> 3"), ("has_after", "(turn + conv_id) % 4 <> 2"), ("absence", p("conv_id + 2 * turn", ["before", "after", None, None, "both", None, None])),
    ("statement", "CASE WHEN (conv_id + turn) % 17 = 0 THEN ' ' ELSE concat(text, ' ', " + p("conv_id * 7 + turn", SENTENCES) + ") END"), ("has_statement", "(conv_id + turn) % 9 <> 0"), ("confidence", p("conv_id * 7 + turn", ["extracted", "inferred", "ambiguous", "unresolved", "unavailable", "sure"])),
]


class Explained:
    """Items of the conversations, and owners and citations over a ledger."""

    def __init__(self, ledger):
        self.x = ledger

    items = cached_property(lambda self: self.x.table("conversations").where("text IS NOT NULL").selectExpr(*[f"{e} AS `{n}`" for n, e in _columns(pick)]))
    #: Ten items that may own evidence.
    owners_of = cached_property(lambda self: self.x.spark.range(4).selectExpr("concat('item_', id) AS item_id"))

    @cached_property
    def entries(self):
        """Owner entries in order: of most lines, of some twice, of spans and non-text units, of unknown evidence and by unknown items."""
        ids, spans, units = self.x.ids, self.x.spans, self.x.units
        a = ids.where("(doc_id + ordinal) % 13 <> 5").selectExpr("1 AS pos", "line_id AS evidence_id", "concat('item_', CASE WHEN doc_id % 7 = 2 THEN ordinal % 3 WHEN ordinal % 17 = 3 THEN 99 ELSE hunk_no % 4 END) AS owner_id")
        b = ids.where("(doc_id + ordinal) % 19 = 7").selectExpr("2", "line_id", "'item_0'")
        c = self.x.files.where("doc_id % 50 = 1").selectExpr("3", "IF(doc_id % 100 = 1, concat('line_unknown', doc_id), '')", "'item_1'")
        d = spans.where("(doc_id + span_no) % 5 = 1").selectExpr("4", "span_id", "concat('item_', IF(doc_id % 3 = 0, 0, hunk_no % 4))")
        e = units.where("kind <> 'text' AND doc_id % 4 <> 1").selectExpr("5", "unit_id", "IF(doc_id % 8 = 2, '', 'item_2')")
        return a.union(b).union(c).union(d).union(e)

    required = cached_property(lambda self: self.x.ids.selectExpr("line_id AS evidence_id").unionByName(self.x.units.where("kind <> 'text'").selectExpr("unit_id AS evidence_id")))
    ownable = cached_property(lambda self: self.required.unionByName(self.x.spans.selectExpr("span_id AS evidence_id")))
    owners = cached_property(lambda self: V.effective(self.entries, self.ownable))

    @cached_property
    def cited(self):
        """Citations of items: ids of spans, hunks and units, plain or as an object, and some that are nothing."""
        s = self.x.spans.selectExpr("concat('item_', hunk_no % 4) AS item_id", "start_line AS pos", "CASE CAST((doc_id + span_no) % 8 AS INT) WHEN 0 THEN span_id WHEN 1 THEN concat('{\"id\":\"', hunk_id, '\"}') WHEN 2 THEN unit_id WHEN 3 THEN concat('{\"id\":\"', hunk_id, '\",\"x\":1}') WHEN 4 THEN concat('none_', doc_id) WHEN 5 THEN '{\"id\":\"\"}' WHEN 6 THEN '' ELSE '{}' END AS citation")
        return s

    @cached_property
    def references(self):
        one = lambda df, c: df.selectExpr(f"{c} AS ref")
        return one(self.x.cited, "citation_id").unionByName(one(self.x.spans, "span_id")).unionByName(one(self.x.ids, "line_id")).unionByName(one(self.x.hunks, "hunk_id")).unionByName(one(self.x.units, "unit_id")).distinct()


def explained(x) -> Explained:
    if not hasattr(x, "_explained"):
        x._explained = Explained(x)
    return x._explained


def _texts(x):
    """Title, statement and both sides of every item."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "statement", "before", "after")])).alias("f")
    return explained(x).items.select(F.col("item_id").alias("id"), fields).select("id", "f.field", "f.value").where("value IS NOT NULL")


def _fields(x):
    return V.forbidden_fields(explained(x).items.selectExpr("item_id AS id", f"{pick('ord', FIELDS)} AS field"))


def _summaries(x):
    """Explanations by conversation; every third one is of a comparison without units."""
    per = explained(x).items.groupBy("group").agg(F.count("*").alias("n"))
    return V.summary_errors(per.selectExpr("group AS id", f"{pick('group', SUMMARIES)} AS summary", "IF(group % 3 = 0, 0, 5) AS n_units", "IF(group % 2 = 0, 0, n) AS n_items"))


def _repeated(x):
    """Ids of evidence with their places; those of every 43rd document's lines and spans come again in another place."""
    row = lambda df, kind, c, place: df.selectExpr(f"{c} AS id", f"'{kind}' AS kind", f"{place} AS path")
    ids, spans = x.ids, x.spans
    first = row(ids, "changed line", "line_id", "concat('files[', doc_id, '].lines[', hunk_no, '.', ordinal, ']')").unionByName(row(spans, "span", "span_id", "concat('files[', doc_id, '].spans[', hunk_no, '.', span_no, ']')"))
    again = row(ids.where("doc_id % 43 = 2"), "graph fact", "line_id", "concat('graph[', doc_id, '.', hunk_no, '.', ordinal, ']')").unionByName(row(spans.where("doc_id % 43 = 2"), "hunk", "span_id", "concat('a[', doc_id, '.', hunk_no, '.', span_no, ']')"))
    return V.repeated_ids(first.unionByName(again))


def _stored(x):
    """Spans and units are written once; owners come from them in many branches."""
    x.store("hunks", "spans", "units")
    return explained(x)


def _coverage(x):
    e = _stored(x)
    return V.coverage(x.ids, e.owners, x.units, e.cited)


def _empty(x):
    """Every file as a comparison: its changed lines and non-text units, and whether a summary and items fit that."""
    n = x.changes.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    units = x.units.where("kind NOT IN ('text', 'unsupported')").groupBy("doc_id").agg(F.count("*").alias("n_units"))
    rows = x.files.select("doc_id").join(n, "doc_id", "left").join(units, "doc_id", "left").na.fill(0)
    told = rows.selectExpr("doc_id AS id", f"{pick('doc_id', SUMMARIES)} AS summary", "n_lines + n_units AS n_units", "doc_id % 2 AS n_items")
    return told.join(V.summary_errors(told), "id", "left").selectExpr("id", "n_units AS n_changes", "error")


def _documents(x):
    """Items as JSON documents with faults."""
    raw = f"""CASE WHEN turn % 7 = 6 THEN 'no json' ELSE concat('{{"id":"', IF(turn % 5 = 4, 'i', concat('i', conv_id)), '","kind":"', {pick('conv_id + turn', KINDS)}, '"', IF(turn % 3 = 2, ',"turn":"x"', concat(',"turn":', turn)), IF(conv_id % 4 = 3, '', concat(',"citations":', {pick('conv_id', ['[]', '["a",{"id":"b"}]', '["A"]', '[{"id":"b","x":1},3]'])})), IF(conv_id % 3 = 1, ',"before":null', IF(conv_id % 3 = 2, ',"before":1', '')), IF(conv_id % 6 = 5, ',"extra":true', ''), '}}') END"""
    return x.table("conversations").selectExpr("concat(conv_id, '_', turn) AS id", f"{raw} AS body")


def _schema(x):
    return schema_errors(_documents(x), "id", "body", SCHEMA)


def _template(x):
    """Owners by conceptual name: of hunks, of some twice, of one hunk more than there are, and of some units."""
    n = x.hunks.groupBy("doc_id", "path").agg(F.count("*").alias("n"))
    hunks = n.select("doc_id", "path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.when(F.col("doc_id") % 9 == 4, 1).otherwise(0))).alias("k")).where("NOT (doc_id % 10 = 3 AND k = 1)").selectExpr("concat('conceptual-hunk:', path, '#', k) AS concept", "concat('item_', IF(doc_id % 5 = 0, k % 3, 1)) AS owner_id", "doc_id", "k")
    units = x.units.where("kind <> 'text' AND doc_id % 3 = 0").selectExpr("concat('conceptual-unit:', path, '#', unit_no) AS concept", "'item_2' AS owner_id")
    return hunks.select("concept", "owner_id").unionByName(hunks.where("doc_id % 12 = 5 AND k = 1").select("concept", "owner_id")).unionByName(units)


def _wanted(x):
    """Assertions of each file: whether it is there, and what it contains or lacks; the fifth has no test."""
    rows = x.files.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n"))
    return rows.selectExpr("concat('a', doc_id, '_', n) AS assertion_id", "doc_id", "IF(n % 2 = 0, 'before', 'after') AS side", "element_at(array('exists', 'exists', 'contains', 'contains', 'lacks', NULL), n + 1) AS test", "IF(n < 3, ' ~', 'the') AS needle", "doc_id % 3 <> 0 AS expected")


def _reports(x):
    """A report of each conversation."""
    e = explained(x)
    items = e.items.withColumn("references", F.expr("filter(array(IF(ord % 2 = 0, concat('span_', ord), NULL), IF(ord % 3 = 0, concat('line_', ord), NULL)), r -> r IS NOT NULL)")).where("kind <> 'Finding' AND confidence <> 'sure'")
    per = e.items.groupBy("group").agg(F.count("*").alias("n"))
    reports = per.selectExpr("group", f"{pick('group', SUMMARIES)} AS summary")
    ratio = lambda o, t: f"IF({t} = 0, 1.0D, {o} / greatest({t}, 1))"
    counts = {"line": ("n", "8L"), "span": ("n div 2", "4L"), "hunk": ("0L", "0L"), "unit": ("1L", "3L")}
    cover = per.selectExpr("group", *[c for k, (o, t) in counts.items() for c in (f"CAST({o} AS LONG) AS {k}_owned", f"{t} AS {k}_total", f"{ratio(o, t)} AS {k}_ratio")], "n AS citation_count")
    owners = e.items.where("ord % 2 = 0").selectExpr("group", "concat('line_', ord) AS evidence_id", "item_id AS owner_id")
    return reports, items, cover, owners


def _json(x):
    from ..functions.text import ascii_json

    return x.files.select("doc_id", canonical_json(F.struct(F.col("doc_id"), F.lit(None).cast("string").alias("none"), "source", "text")).alias("json"))


BUILD = {
    "owner_missing": lambda x: V.missing(_stored(x).required, _stored(x).owners),
    "owner_duplicate": lambda x: V.duplicates(_stored(x).entries.where("coalesce(owner_id, '') <> ''").join(_stored(x).ownable, "evidence_id", "left_semi")),
    "owner_unknown": lambda x: V.owner_errors(_stored(x).entries, _stored(x).ownable, _stored(x).owners_of),
    "owned_lines": lambda x: _stored(x).x.ids.selectExpr("line_id AS evidence_id").join(explained(x).owners, "evidence_id"),
    "span_effective_owner": lambda x: V.span_owner(_stored(x).x.ids, explained(x).owners).select("span_id", "state", "owner_id", "error"),
    "coverage_summary": _coverage,
    "empty_comparison": _empty,
    "citation_refs": lambda x: V.citation_errors(_stored(x).cited, _stored(x).references).groupBy("item_id", "error").agg(F.count("*").alias("n")),
    "item_rules": lambda x: V.item_errors(explained(x).items).where("error NOT LIKE '%need%' AND error NOT LIKE '%wording'"),
    "confidence_rules": lambda x: V.item_errors(explained(x).items).where("error LIKE '%need%' OR error LIKE '%wording'"),
    "policy_text": lambda x: V.policy_errors(_texts(x)),
    "policy_fields": _fields,
    "policy_kinds": lambda x: V.forbidden_kinds(explained(x).items),
    "summary_rules": _summaries,
    "repeated_ids": _repeated,
    "json_schema_errors": _schema,
    "report_sections": lambda x: R.sections(explained(x).items),
    "report_markdown": lambda x: R.report_markdown(*_reports(x)),
    "report_json": lambda x: R.report_json(*_reports(x)),
    "canonical_json": _json,
    "assertion_eval": lambda x: R.assertions(_wanted(x), x.texts),
    "assertion_counts": lambda x: R.assertions(_wanted(x), x.texts).groupBy("status").agg(F.count("*").alias("n")),
    "manifest_instantiate": lambda x: X.instantiated(_template(x.store("hunks", "spans", "units")), x.hunks, x.units, x.ids)[0],
    "manifest_errors": lambda x: X.instantiated(_template(x.store("hunks", "units")), x.hunks, x.units, x.ids)[1],
}

_bool = lambda c: f"coalesce({c}, false)"
_filled = lambda c: f"trim(coalesce({c}, '')) <> ''"
_re = lambda v, p: f"regexp_matches({v}, {quote(p)})"
_plain = lambda v: f"regexp_replace({v}, {quote(V.QUOTED)}, '', 'g')"
_ITEMS = "items AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _columns(choose)) + " FROM conversations WHERE text IS NOT NULL)"
_side = lambda s: f"CASE WHEN {_bool(f'absence = {quote(s)}')} THEN has_{s} AND {s} IS NULL ELSE {_filled(s)} END"
_beh, _doubt = _bool("kind = 'behavioral'"), _bool("confidence IN ('unresolved', 'unavailable')")
_prose = _plain("concat_ws(' ', coalesce(statement, ''), coalesce(before, ''), coalesce(after, ''), coalesce(title, ''))")
_RULES = [
    ("unknown kind", f"NOT {_bool(f'kind IN {tuple(V.KINDS)}')}"), ("unknown confidence", f"NOT {_bool(f'confidence IN {tuple(V.CONFIDENCE)}')}"), ("title is empty", f"NOT ({_filled('title')})"), ("statement is empty", f"has_statement AND statement IS NOT NULL AND NOT ({_filled('statement')})"),
    ("absence is neither before nor after", f"{_beh} AND absence IS NOT NULL AND absence NOT IN ('before', 'after')"), ("behavioral needs both sides or a declared absence", f"{_beh} AND NOT (({_side('before')}) AND ({_side('after')}))"), ("absence without behavior", f"NOT {_beh} AND absence IS NOT NULL"),
    ("one side only", f"NOT {_beh} AND has_before <> has_after"), ("a side is empty", f"NOT {_beh} AND has_before AND has_after AND NOT ({_filled('before')} AND {_filled('after')})"), ("ambiguity needs ambiguous", f"{_bool(chr(107) + 'ind = ' + quote('ambiguity'))} AND NOT {_bool('confidence = ' + quote('ambiguous'))}"),
    ("unresolved needs unresolved or unavailable", f"{_bool('kind = ' + quote('unresolved'))} AND NOT {_doubt}"), ("ambiguous needs ambiguity", f"{_bool('confidence = ' + quote('ambiguous'))} AND NOT {_bool('kind = ' + quote('ambiguity'))}"), ("unresolved or unavailable needs unresolved", f"{_doubt} AND NOT {_bool('kind = ' + quote('unresolved'))}"),
    ("extracted forbids uncertain wording", f"{_bool('confidence = ' + quote('extracted'))} AND ({' OR '.join(_re(_prose, p) for p in (V.UNCERTAIN, V.MIGHT, V.MAY, V.MODAL))})"),
]
_errors = lambda picked: f"WITH {_ITEMS} " + " UNION ALL ".join(f"SELECT item_id, {quote(t)} AS error FROM items WHERE {c}" for t, c in _RULES if picked(t))
_about = lambda t: "need" in t or t.endswith("wording")
_OWN = """
en_ AS (SELECT 1 AS pos, line_id AS evidence_id, 'item_' || CASE WHEN doc_id % 7 = 2 THEN ordinal % 3 WHEN ordinal % 17 = 3 THEN 99 ELSE hunk_no % 4 END AS owner_id FROM li WHERE (doc_id + ordinal) % 13 <> 5
  UNION ALL SELECT 2, line_id, 'item_0' FROM li WHERE (doc_id + ordinal) % 19 = 7 UNION ALL SELECT 3, CASE WHEN doc_id % 100 = 1 THEN 'line_unknown' || doc_id ELSE '' END, 'item_1' FROM files WHERE doc_id % 50 = 1
  UNION ALL SELECT 4, span_id, 'item_' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE hunk_no % 4 END FROM spans WHERE (doc_id + span_no) % 5 = 1 UNION ALL SELECT 5, unit_id, CASE WHEN doc_id % 8 = 2 THEN '' ELSE 'item_2' END FROM units WHERE kind <> 'text' AND doc_id % 4 <> 1),
rq AS (SELECT line_id AS evidence_id FROM li UNION ALL SELECT unit_id FROM units WHERE kind <> 'text'), ow AS (SELECT evidence_id FROM rq UNION ALL SELECT span_id FROM spans),
good AS (SELECT * FROM en_ WHERE owner_id <> '' AND evidence_id IN (SELECT evidence_id FROM ow)),
own AS (SELECT evidence_id, arg_min(owner_id, pos) AS owner_id FROM good GROUP BY evidence_id)"""
_CITED = """
ct AS (SELECT 'item_' || hunk_no % 4 AS item_id, CASE CAST((doc_id + span_no) % 8 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'neither an id nor an object with only an id' WHEN 4 THEN 'unknown reference' WHEN 5 THEN 'empty id' WHEN 6 THEN 'empty id' ELSE 'neither an id nor an object with only an id' END AS error FROM spans)"""
_cov = lambda k: f"CASE WHEN {k}_total = 0 THEN 1.0::DOUBLE ELSE {k}_owned / greatest({k}_total, 1)::DOUBLE END AS {k}_ratio"
_TEMPLATE = """
tn AS (SELECT doc_id, path, count(*) AS n FROM hunks GROUP BY ALL),
th AS (SELECT doc_id, k, 'conceptual-hunk:' || path || '#' || k AS concept, 'item_' || CASE WHEN doc_id % 5 = 0 THEN k % 3 ELSE 1 END AS owner_id FROM (SELECT doc_id, path, unnest(range(1, CAST(n + CASE WHEN doc_id % 9 = 4 THEN 2 ELSE 1 END AS BIGINT))) AS k FROM tn) WHERE NOT (doc_id % 10 = 3 AND k = 1)),
te AS (SELECT concept, owner_id FROM th UNION ALL SELECT concept, owner_id FROM th WHERE doc_id % 12 = 5 AND k = 1 UNION ALL SELECT 'conceptual-unit:' || path || '#' || unit_no, 'item_2' FROM units WHERE kind <> 'text' AND doc_id % 3 = 0),
t1 AS (SELECT concept, min(owner_id) AS owner_id, count(*) AS n FROM te GROUP BY concept),
hc AS (SELECT hunk_id, h.doc_id, 'conceptual-hunk:' || path || '#' || hunk_no AS concept, owner_id FROM hunks h LEFT JOIN t1 ON t1.concept = 'conceptual-hunk:' || path || '#' || hunk_no),
hf AS (SELECT doc_id, count(DISTINCT owner_id) AS d, min(owner_id) AS only_ FROM hc GROUP BY doc_id),
uc AS (SELECT unit_id, 'conceptual-unit:' || path || '#' || unit_no AS concept, coalesce(owner_id, CASE WHEN d = 1 THEN only_ END) AS owner_id FROM units u LEFT JOIN t1 ON t1.concept = 'conceptual-unit:' || path || '#' || unit_no LEFT JOIN hf USING (doc_id) WHERE kind <> 'text')"""
_body = f"""CASE WHEN turn % 7 = 6 THEN 'no json' ELSE concat('{{"id":"', CASE WHEN turn % 5 = 4 THEN 'i' ELSE 'i' || conv_id END) END"""


def _schema_sql() -> str:
    """The broken rules by the numbers that made the documents."""
    kind = choose("conv_id + turn", KINDS)
    rows = [
        ("turn % 7 = 6", "$", "is no JSON"), ("turn % 5 = 4", "$.id", "is shorter than 3"), ("turn % 5 <> 4 AND length('i' || conv_id) < 3", "$.id", "is shorter than 3"), (f"{kind} = 'Finding'", "$.kind", "is none of the allowed values"),
        ("turn % 3 = 2", "$.turn", "is not of type integer"), ("turn % 3 <> 2 AND turn > 3", "$.turn", "is above 3"), ("conv_id % 4 = 3", "$.citations", "is missing"), ("conv_id % 4 = 0", "$.citations", "has fewer than 1 items"),
        ("conv_id % 4 = 2", "$.citations[0]", "fits none or several of the alternatives"), ("conv_id % 3 = 2", "$.before", "is not of type string or null"), ("conv_id % 6 = 5", "$.extra", "is not allowed"), (f"conv_id % 3 = 0 AND {kind} = 'behavioral'", "$.before", "is missing"),
    ]
    return " UNION ALL ".join(f"SELECT conv_id || '_' || turn AS id, {quote(p)} AS path, {quote(e)} AS error FROM conversations WHERE {'' if e == 'is no JSON' else 'turn % 7 <> 6 AND '}{c}" for c, p, e in rows)


_pct = lambda r: f"CAST(CAST(round_even({r} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_absent = lambda s: f"CASE WHEN {_bool(f'absence = {quote(s)}')} THEN 'Absent' ELSE coalesce({s}, '') END"
_nl = "chr(10)"
_REPORT = f"""
ri0 AS (SELECT *, list_filter([CASE WHEN ord % 2 = 0 THEN 'span_' || ord END, CASE WHEN ord % 3 = 0 THEN 'line_' || ord END], lambda r: r IS NOT NULL) AS refs, CASE WHEN kind = 'unresolved' THEN 'ambiguity' ELSE kind END AS section FROM items WHERE kind <> 'Finding' AND confidence <> 'sure'),
ri1 AS (SELECT *, concat_ws({_nl}, '### ' || title, '', CASE WHEN has_before AND has_after THEN concat_ws({_nl}, '**Before:** ' || {_absent('before')}, '', '**After:** ' || {_absent('after')}, '') END, CASE WHEN coalesce(statement, '') <> '' THEN statement || {_nl} END, CASE WHEN len(refs) > 0 THEN 'Evidence: ' || list_aggregate(list_transform(refs, lambda r: '`' || r || '`'), 'string_agg', ', ') || {_nl} END, 'Confidence: **' || confidence || '**' || {_nl}) AS md FROM ri0),
rp AS (SELECT "group", {', '.join(f"string_agg(md, {_nl} ORDER BY ord, item_id) FILTER (section = '{s}') AS {s}" for s in R.SECTIONS)}, {', '.join(f"coalesce(list(item_id ORDER BY ord, item_id) FILTER (section = '{s}'), []) AS l_{s}" for s in R.SECTIONS)} FROM ri1 GROUP BY "group"),
rn AS (SELECT "group", count(*) AS n FROM items GROUP BY "group"),
rc AS (SELECT "group", {choose('"group"', SUMMARIES)} AS summary, n AS line_owned, 8 AS line_total, n / 8.0::DOUBLE AS line_ratio, n // 2 AS span_owned, 4 AS span_total, (n // 2) / 4.0::DOUBLE AS span_ratio, 0 AS hunk_owned, 0 AS hunk_total, 1.0::DOUBLE AS hunk_ratio, 1 AS unit_owned, 3 AS unit_total, 1 / 3.0::DOUBLE AS unit_ratio, n AS citation_count FROM rn),
ro AS (SELECT "group", string_agg('| `line_' || ord || '` | `' || item_id || '` |', {_nl} ORDER BY 'line_' || ord, item_id) AS owner_text, list({{'evidence_id': 'line_' || ord, 'owner_id': item_id}} ORDER BY 'line_' || ord, item_id) AS owners FROM items WHERE ord % 2 = 0 GROUP BY "group")"""
_share = lambda label, k: f"'- {label}: ' || {k}_owned || '/' || {k}_total || ' (' || {_pct(k + '_ratio')} || ')'"
_sections = ", ".join(f"'## {t}', '', CASE WHEN coalesce({s}, '') = '' THEN '{R.NONE}' || {_nl} ELSE {s} END" for s, t in R.SECTIONS.items())
_counts = sorted([f"{k}_{x}" for k in ("line", "span", "hunk", "unit") for x in ("owned", "ratio", "total")] + ["citation_count"])

SQL = {
    "owner_missing": f"{BASE}, {_OWN} SELECT evidence_id FROM rq WHERE evidence_id NOT IN (SELECT evidence_id FROM own)",
    "owner_duplicate": f"{BASE}, {_OWN} SELECT evidence_id, count(*) AS n_entries, string_agg(DISTINCT owner_id, ',' ORDER BY owner_id) AS owners FROM good GROUP BY evidence_id HAVING count(*) > 1",
    "owner_unknown": f"{BASE}, {_OWN} SELECT evidence_id, owner_id, CASE WHEN evidence_id = '' THEN 'empty evidence' WHEN evidence_id NOT IN (SELECT evidence_id FROM ow) THEN 'unknown evidence' WHEN owner_id = '' THEN 'empty owner' ELSE 'unknown owner' END AS error FROM en_ WHERE evidence_id NOT IN (SELECT evidence_id FROM ow) OR owner_id NOT IN ('item_0', 'item_1', 'item_2', 'item_3')",
    "owned_lines": f"{BASE}, {_OWN} SELECT evidence_id, owner_id FROM own WHERE evidence_id IN (SELECT line_id FROM li)",
    "span_effective_owner": f"{BASE}, {_OWN}, p AS (SELECT li.span_id, count(*) AS n, count(owner_id) AS owned, count(DISTINCT owner_id) AS d, min(owner_id) AS o FROM li LEFT JOIN own ON line_id = evidence_id GROUP BY li.span_id), q AS (SELECT *, CASE WHEN d > 1 THEN 'cross' WHEN owned = 0 THEN 'none' WHEN owned < n THEN 'partial' ELSE 'owned' END AS state FROM p) SELECT span_id, state, CASE WHEN d = 1 AND owned = n THEN o END AS owner_id, CASE WHEN state = 'cross' THEN 'cross-owner coverage' WHEN s.owner_id IS NULL THEN NULL WHEN state <> 'owned' THEN 'baseless direct owner' WHEN s.owner_id <> o THEN 'direct owner mismatch' END AS error FROM q LEFT JOIN own s ON span_id = evidence_id",
    "coverage_summary": f"{BASE}, {_OWN}, x AS (SELECT li.*, owner_id FROM li LEFT JOIN own ON line_id = evidence_id), l AS (SELECT count(*) AS line_total, count(owner_id) AS line_owned FROM x), s AS (SELECT count(*) AS span_total, count(*) FILTER (ok) AS span_owned FROM (SELECT span_id, count(DISTINCT owner_id) = 1 AND count(owner_id) = count(*) AS ok FROM x GROUP BY span_id)), h AS (SELECT count(*) AS hunk_total, count(*) FILTER (ok) AS hunk_owned FROM (SELECT hunk_id, count(owner_id) = count(*) AS ok FROM x GROUP BY hunk_id)), ut AS (SELECT unit_id, count(owner_id) = count(*) AS ok FROM x GROUP BY unit_id), u AS (SELECT count(*) AS unit_total, count(*) FILTER (CASE WHEN kind = 'text' THEN coalesce(ok, false) ELSE unit_id IN (SELECT evidence_id FROM own) END) AS unit_owned FROM units LEFT JOIN ut USING (unit_id)), c AS (SELECT count(*) AS citation_count FROM spans) SELECT *, {_cov('line')}, {_cov('span')}, {_cov('hunk')}, {_cov('unit')} FROM l, s, h, u, c",
    "empty_comparison": f"""{BASE}, n AS (SELECT f.doc_id AS id, (SELECT count(*) FROM ch WHERE ch.doc_id = f.doc_id) + (SELECT count(*) FROM units u WHERE u.doc_id = f.doc_id AND u.kind NOT IN ('text', 'unsupported')) AS n_changes, {choose('f.doc_id', SUMMARIES)} AS summary FROM files f),
e AS (SELECT id, 'summary is empty' AS error FROM n WHERE summary = '' UNION ALL SELECT id, 'nothing changed, but the summary doesn''t say so' FROM n WHERE n_changes = 0 AND NOT {_re('summary', V.UNCHANGED)} UNION ALL SELECT id, 'nothing changed, but there are items' FROM n WHERE n_changes = 0 AND id % 2 = 1)
SELECT id, n_changes, error FROM n LEFT JOIN e USING (id)""",
    "citation_refs": f"{BASE}, {_CITED} SELECT item_id, error, count(*) AS n FROM ct WHERE error IS NOT NULL GROUP BY ALL",
    "item_rules": _errors(lambda t: not _about(t)),
    "confidence_rules": _errors(_about),
    "policy_text": f"WITH {_ITEMS}, fi AS (" + " UNION ALL ".join(f"SELECT item_id AS id, '{c}' AS field, {_plain(c)} AS v FROM items WHERE {c} IS NOT NULL" for c in ("title", "statement", "before", "after")) + ") " + " UNION ALL ".join([f"SELECT id, field, 0 AS rule, 'defect or security finding' AS intent FROM fi WHERE field = 'title' AND {_re('v', V.TITLE)}", *[f"SELECT id, field, {k}, {quote(i)} FROM fi WHERE {_re('v', p)}" for k, (i, p) in enumerate(V.POLICY, 1)]]),
    "policy_fields": f"WITH {_ITEMS}, vals AS (SELECT item_id AS id, {choose('ord', FIELDS)} AS field FROM items) SELECT id, field FROM vals WHERE replace(lower(field), '-', '_') IN {tuple(V.FORBIDDEN)}",
    "policy_kinds": f"WITH {_ITEMS} SELECT item_id, kind FROM items WHERE lower(kind) IN {tuple(V.FORBIDDEN_KINDS)}",
    "summary_rules": f"""WITH {_ITEMS}, s AS (SELECT "group" AS id, {choose('"group"', SUMMARIES)} AS summary, CASE WHEN "group" % 3 = 0 THEN 0 ELSE 5 END AS n_units, CASE WHEN "group" % 2 = 0 THEN 0 ELSE count(*) END AS n_items FROM items GROUP BY "group") SELECT id, 'summary is empty' AS error FROM s WHERE summary = '' UNION ALL SELECT id, 'nothing changed, but the summary doesn''t say so' FROM s WHERE n_units = 0 AND NOT {_re('summary', V.UNCHANGED)} UNION ALL SELECT id, 'nothing changed, but there are items' FROM s WHERE n_units = 0 AND n_items > 0""",
    "repeated_ids": f"{BASE} SELECT line_id AS id, 'graph fact' AS kind, 'graph[' || doc_id || '.' || hunk_no || '.' || ordinal || ']' AS path, 'changed line' AS first_kind, 'files[' || doc_id || '].lines[' || hunk_no || '.' || ordinal || ']' AS first_path FROM li WHERE doc_id % 43 = 2 UNION ALL SELECT span_id, 'span', 'files[' || doc_id || '].spans[' || hunk_no || '.' || span_no || ']', 'hunk', 'a[' || doc_id || '.' || hunk_no || '.' || span_no || ']' FROM spans WHERE doc_id % 43 = 2",
    "json_schema_errors": f"SELECT DISTINCT * FROM ({_schema_sql()})",
    "report_sections": f"""WITH {_ITEMS} SELECT "group", section, row_number() OVER (PARTITION BY "group", section ORDER BY ord, item_id) AS position, item_id FROM (SELECT "group", CASE WHEN kind = 'unresolved' THEN 'ambiguity' ELSE kind END AS section, ord, item_id FROM items)""",
    "report_markdown": f"""WITH {_ITEMS}, {_REPORT} SELECT "group", concat_ws({_nl}, '# Explanation', '', summary, '', {_sections}, '## Complete source-cited coverage appendix', '', {_share('Changed lines', 'line')}, {_share('Change spans', 'span')}, {_share('Textual hunks', 'hunk')}, {_share('Change units', 'unit')}, '- Valid citation references: ' || citation_count, '', 'Spans without a direct entry inherit the unanimous owner of their changed lines.', '', '| Directly owned evidence | Coverage owner |', '|---|---|', owner_text, '', '> {R.GUARANTEE}', '') AS markdown FROM rc LEFT JOIN rp USING ("group") LEFT JOIN ro USING ("group")""",
    "report_json": f"""WITH {_ITEMS}, {_REPORT} SELECT "group", CAST(json_object('coverage', json_object({', '.join(f"'{c}', {c}" for c in _counts)}), 'coverage_owners', owners, 'guarantee', '{R.GUARANTEE}', 'sections', json_object({', '.join(f"'{s}', coalesce(l_{s}, [])" for s in sorted(R.SECTIONS))}), 'summary', summary) AS VARCHAR) || {_nl} AS json FROM rc LEFT JOIN rp USING ("group") LEFT JOIN ro USING ("group")""",
    "assertion_eval": f"{BASE}, t AS (SELECT doc_id, side, string_agg(content, chr(10) ORDER BY line) AS text FROM snap GROUP BY ALL), w AS (SELECT 'a' || doc_id || '_' || n AS assertion_id, doc_id, CASE WHEN n % 2 = 0 THEN 'before' ELSE 'after' END AS side, CASE CAST(n AS INTEGER) WHEN 0 THEN 'exists' WHEN 1 THEN 'exists' WHEN 2 THEN 'contains' WHEN 3 THEN 'contains' WHEN 4 THEN 'lacks' END AS test, CASE WHEN n < 3 THEN ' ~' ELSE 'the' END AS needle, doc_id % 3 <> 0 AS expected FROM files, range(6) r(n)) SELECT assertion_id, doc_id, side, CASE WHEN test IS NULL THEN 'skip' WHEN CASE test WHEN 'exists' THEN (text IS NOT NULL) = expected WHEN 'contains' THEN coalesce(contains(text, needle), false) ELSE NOT coalesce(contains(text, needle), false) END THEN 'pass' ELSE 'fail' END AS status FROM w LEFT JOIN t USING (doc_id, side)",
    "manifest_instantiate": f"{BASE}, {_TEMPLATE} SELECT line_id AS evidence_id, owner_id FROM li JOIN hc USING (hunk_id) WHERE owner_id IS NOT NULL UNION ALL SELECT unit_id, owner_id FROM uc WHERE owner_id IS NOT NULL",
    "manifest_errors": f"{BASE}, {_TEMPLATE} SELECT concept, 'named twice' AS error FROM t1 WHERE n > 1 UNION ALL SELECT concept, 'no such evidence' FROM t1 WHERE concept NOT IN (SELECT concept FROM hc UNION ALL SELECT 'conceptual-unit:' || path || '#' || unit_no FROM units) UNION ALL SELECT concept, 'hunk without owner' FROM hc WHERE owner_id IS NULL UNION ALL SELECT concept, 'unit without an only owner' FROM uc WHERE owner_id IS NULL",
}
SQL["canonical_json"] = f"{BASE}, j AS (SELECT doc_id, CAST(json_object('doc_id', doc_id, 'none', NULL, 'source', source, 'text', text) AS VARCHAR) AS j FROM files) SELECT doc_id, list_aggregate(list_transform(string_split(j, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE printf('\\u%04x', unicode(c)) END), 'string_agg', '') || chr(10) AS json FROM j"
SQL["assertion_counts"] = f"SELECT status, count(*) AS n FROM ({SQL['assertion_eval']}) GROUP BY status"
