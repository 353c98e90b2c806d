"""Queries over the change ledger and its patches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import ledger as L
from ..operators import patch as P
from ..operators import report as R
from ..operators import validate as V
from ..sources import snapshot as N
from ..sources.patch_files import patch_records
from ..sources.tables import shared_dir, written
from .base import BASE, BUDGET, PATCH, Ledger, digest, quote, sid

ID = "hunk_id, doc_id, hunk_no, old_start, old_count, new_start, new_count, n_blocks, heading, raw_patch_bytes, patch_hash"


def _metrics_by_source(x):
    """Counts by source and class, from one row a file: spans and links are counted where the lines are."""
    x.store("hunks")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("n_lines")).otherwise(0))
    per = x.linked.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count("replacement_span_id").alias("replaced"), side("after").alias("added"), side("before").alias("deleted"))
    total = lambda c, name: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(name)
    return x.classes.join(per, "doc_id", "left").groupBy("source", "classification").agg(F.count("*").alias("files"), total("spans", "spans"), total("added", "added_lines"), total("deleted", "deleted_lines"), total("replaced", "replaced_spans"))


def _inventory(x):
    """Counts of the ledger beside counts of marked lines in the patch text, which lacks its last line for every 41st document."""
    ledger = x.changed.groupBy("doc_id").agg(F.count_if(F.col("side") == "before").alias("ledger_deleted"), F.count_if(F.col("side") == "after").alias("ledger_added"))
    text = F.when(F.col("doc_id") % 41 == 3, F.regexp_replace("patch", r"[^\n]*\n(?:\\[^\n]*\n)?$", "")).otherwise(F.col("patch"))
    marked = lambda m: F.size(F.filter(F.split(text, "\n"), lambda s: s.rlike(f"^{m}") & ~s.rlike(r"^(?:---|\+\+\+) (?:\"?[ab]/|/dev/null)")))
    direct = x.patches.join(x.files.where("coalesce(new_mode, old_mode) <> '160000'").select("doc_id"), "doc_id", "left_semi").select("doc_id", marked("-").alias("d"), marked(r"\+").alias("a"))
    return ledger.join(direct, "doc_id").selectExpr("doc_id", "ledger_deleted", "ledger_added", "ledger_deleted = d AND ledger_added = a AS equal")


def _broken_snapshot(x):
    """The snapshot with faults: changed first lines in every 37th file, no lines behind the third in every 31st."""
    return x.snapshot.where("NOT (doc_id % 31 = 5 AND line > 3)").withColumn("content", F.expr("IF(doc_id % 37 = 2 AND line = 1, concat(content, 'x'), content)"))


def _collisions(x):
    one = lambda df, kind, more: df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id")).unionByName(df.where(more).select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id")))
    rows = one(x.ids, "line", "doc_id % 53 = 1").unionByName(one(x.spans, "span", "doc_id % 53 = 2")).unionByName(one(x.hunks, "hunk", "false")).unionByName(one(x.units, "unit", "false"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_ids"), F.count_distinct("id").alias("n_distinct"))


def _links(x):
    """Replacement links with planted faults: one end points at itself, or at nothing."""
    end = F.expr("CASE WHEN doc_id % 17 = 4 AND side = 'before' THEN span_id WHEN doc_id % 17 = 5 AND side = 'after' THEN 'span_none' ELSE replacement_span_id END")
    return L.asymmetric(x.linked.where("replacement_span_id IS NOT NULL").withColumn("replacement_span_id", end))


def _renames(x):
    side = lambda odd, name: x.files.where(f"doc_id % 2 = {odd}").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("path").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return side(0, "new_path").join(side(1, "old_path"), "h").select("old_path", "new_path")


def _manifest(x):
    return C.file_hashes(x.snapshot).join(x.files.select("path", "old_mode", "new_mode"), "path").withColumn("mode", F.expr("IF(side = 'before', old_mode, new_mode)"))


def _patch_source(x):
    """Changed lines of patches that are written to files, many to a file, and read from there in parts."""
    at = f"{shared_dir(x.spark)}/patches-{uuid.uuid4().hex}"
    x.patches.select(F.regexp_replace("patch", r"\n\z", "").alias("patch")).write.text(at)
    read = P.Patch.of(patch_records(x.spark, at)).text_lines
    return read.selectExpr("coalesce(new_path, old_path) AS path", "side", "line", "hunk_no", "ordinal", "content", "content_hash", "no_newline")


def _facts(x):
    from .graphs import stored

    return stored(x).found


def _evidence(x):
    x.store("hunks", "linked")
    x.__dict__["spans"] = x.linked
    return R.evidence_markdown(x.files.join(x.classes.select("doc_id", "classification", "confidence").hint("merge"), "doc_id"), x.units, x.hunks, x.linked, x.ids, x.budgeted)


def _appendix(x):
    return R.appendix_markdown(x.store("hunks", "spans").budgeted, _facts(x))


def _overview(x):
    metrics = _metrics(x)
    told = x.outcomes.where("outcome <> 'fits'").groupBy("doc_id").agg(F.max("outcome").alias("outcome"))
    pick = lambda k: F.when(F.col("outcome") == "exceeded", C.EXCEEDED[k]).otherwise(C.OMITTED[k])
    return R.overview_markdown(metrics, x.groups, "documents", "available", told.select("doc_id", pick(0).alias("code"), pick(1).alias("message")))


def _metrics(x):
    x.store("hunks", "spans", "units", "outcomes")
    return L.metrics(x.files, x.hunks, x.spans, x.units, x.outcomes, _facts(x), x.groups, x.patches)


#: Faults that are planted in patches, by doc_id % 13: what the text is made of p, and the error that each hunk or record then has.
FAULTS = {
    0: ("concat('junk\\n', p)", "record 0", "data before the first record"),
    1: ("regexp_replace(p, '@@ -([0-9]+)(,[0-9]+)? ', '@@ -$1,9999 ')", "hunk", "totals differ from the header"),
    2: ("replace(p, '\\nindex ', '\\nindex zz')", "index", "malformed index line"),
    3: ("regexp_replace(p, '(@@ section [0-9]+\\n)', '$1\\\\\\\\ No newline at end of file\\n')", "own", "orphan marker"),
    4: ("replace(p, ' @@ section', ' @ section')", "own", "malformed hunk header"),
    5: ("regexp_replace(p, '(@@ section [0-9]+\\n)', '$1?\\n')", "own", "unexpected line"),
    6: ("regexp_replace(p, '(@@ section [0-9]+\\n)', '$1\\n')", "own", "empty line"),
    7: ("regexp_replace(p, '(diff --git [^\\n]*\\n)', '$1rename from \"x\\n')", "record", "quoted path"),
}


def _fault_patches(x):
    case = " ".join(f"WHEN {k} THEN {e}" for k, (e, _, _) in FAULTS.items())
    return x.patches.selectExpr("doc_id", "patch AS p").selectExpr("doc_id", f"CASE CAST(doc_id % 13 AS INT) {case} ELSE p END AS patch")


def _patch_errors(x):
    # a patch is read in six branches, so patches are written once
    return P.Patch(written(x.spark, _fault_patches(x), "patches"), "doc_id").errors.selectExpr("key AS doc_id", "rec", "hunk_no", "error")


def _parsed(x):
    return P.Patch(x.patches, "path")


def _patch_ledger(x):
    """Ids of a ledger that is made from parsed patches alone. They are read in several branches and so written once."""
    read = P.Patch(written(x.spark, x.patches, "patches"), "path")
    files = read.files.where("coalesce(new_mode, old_mode, '') <> '160000'").withColumn("doc_id", F.col("key"))
    hunks = read.hunks.withColumnRenamed("key", "doc_id").join(files.select("doc_id", "rec"), ["doc_id", "rec"]).drop("rec")
    named = L.with_ids(hunks.withColumn("path", F.col("doc_id")), files)
    only = F.filter("rows", lambda r: r["kind"] != "keep")
    row = named.select("doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id", "old_start", "new_start", F.posexplode(only).alias("ordinal", "r"))
    lines = row.selectExpr("doc_id", "path", "old_path", "new_path", "hunk_no", "unit_id", "hunk_id", "CAST(ordinal AS LONG) AS ordinal", "r.kind AS side", "IF(r.kind = 'before', old_start + r.o, new_start + r.n) AS line", "r.block", "r.content", "r.content_hash", "r.no_newline")
    return L.line_rows(L.spans(lines)).select("line_id", "span_id", "hunk_id", "unit_id")


def _bytes(x):
    """Patches as bytes in which every inserted line ends with a byte that is no UTF-8, and the lines as they are shown."""
    raw = F.expr("encode(regexp_replace(decode(encode(patch, 'UTF-8'), 'ISO-8859-1'), '(?md)^(\\\\+\\\\+ [^\\n]*)$', '$1\xff'), 'ISO-8859-1')")
    return P.Patch(x.patches.withColumn("patch", raw), "path").text_lines.where("undecodable").selectExpr("key AS path", "line", "content", "content_hash")


def _quoting(x):
    from ..functions.text import byte_text, display, fenced, quoted, unquoted

    odd = F.concat("text", F.lit('\t"\\'))
    rows = x.files.select("doc_id", odd.alias("p")).select("doc_id", "p", quoted(F.col("p")).alias("q"))
    back = fenced(rows.select("doc_id", "p", F.length("q").cast("long").alias("n_quoted"), unquoted(byte_text(F.encode("q", "UTF-8"))).alias("u")))
    return back.select("doc_id", "n_quoted", (display(F.col("u")) == F.col("p")).alias("same"))


#: name: function of a Ledger.
BUILD = {
    "line_scan": lambda x: x.lines.select("doc_id", "line_no", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_hash")),
    "change_lines": lambda x: x.changes,
    "hunk_grouping": lambda x: x.hunks.selectExpr(*ID.split(", ")),
    "span_islands": lambda x: x.spans.select("doc_id", "hunk_no", "span_no", "side", "start_line", "end_line", "n_lines"),
    "replacement_links": lambda x: x.linked.where("replacement_span_id IS NOT NULL").select("span_id", "side", "replacement_span_id"),
    "replacement_faults": _links,
    "stable_ids": lambda x: x.ids.select("line_id", "span_id", "hunk_id", "unit_id"),
    "units_nontext": lambda x: x.units.where("kind NOT IN ('text', 'unsupported')").select("unit_id", "doc_id", "unit_no", "kind", "metadata"),
    "units_unsupported": lambda x: x.units.where("kind = 'unsupported'").select("unit_id", "doc_id", "unit_no", "kind", "metadata"),
    "units_text": lambda x: x.units.where("kind = 'text'").select("unit_id", "doc_id", "unit_no", "kind", "metadata"),
    "classify_files": lambda x: x.classes.select("doc_id", "path", "status", "classification", "confidence"),
    "formatting_only": lambda x: L.formatting_only(x.hunks),
    "groups_by_class": lambda x: x.groups,
    "ledger_metrics": _metrics,
    "metrics_by_source": _metrics_by_source,
    "inventory_diff": _inventory,
    "citations_text": lambda x: x.cited.select("citation_id", "span_id", "path", "side", "start_line", "end_line", "content_hash"),
    "source_hash_check": lambda x: C.source_check(x.changed, _broken_snapshot(x)),
    "hierarchy_violations": lambda x: V.violations(x.ids, "line_id", x.ids.where("ordinal % 7 <> 3").select("line_id").unionByName(x.ids.where("ordinal % 11 = 1").select("line_id")), "line_id"),
    "hunk_members": lambda x: V.unequal_members(x.ids.select("hunk_id", "line_id"), x.ids.where("(doc_id + ordinal) % 19 <> 4").select("hunk_id", "line_id"), "hunk_id", "line_id"),
    "orphan_references": lambda x: x.spans.join(x.hunks.where("hunk_no % 2 = 1").select("hunk_id"), "hunk_id", "left_anti").select("span_id"),
    "id_collisions": _collisions,
    "budget_omission": lambda x: x.budgeted.select("citation_id", "doc_id", "saves", "omitted", "outcome", "evidence_bytes"),
    "omissions": lambda x: C.omissions(x.budgeted),
    "whole_budget": lambda x: C.whole_budget(x.cited, WHOLE).select("citation_id", "doc_id", "saves", "omitted", "outcome", "evidence_bytes"),
    "changed_paths": lambda x: x.files.select(F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("old_path").alias("path")), F.struct(F.lit("after").alias("side"), F.col("new_path").alias("path")))).alias("p")).select("p.*").where("path IS NOT NULL").distinct(),
    "changed_lines": lambda x: x.changed.groupBy("side", F.expr("IF(side = 'before', old_path, new_path) AS path")).agg(F.array_join(F.array_sort(F.collect_list("line")).cast("array<string>"), ",").alias("lines")),
    "snapshot_digest": lambda x: C.digests(_manifest(x)),
    "rename_candidates": _renames,
    "patch_text": lambda x: x.patches.select("doc_id", F.octet_length("patch").cast("long").alias("n_bytes"), F.sha2("patch", 256).alias("patch_hash")),
    "patch_parse": lambda x: P.parse_patch(x.store("hunks").patches).select("path", "side", "line", "hunk_no", "ordinal", "content", "content_hash", "no_newline"),
    "patch_files": lambda x: _parsed(x).files.select(F.col("key").alias("path"), "old_path", "new_path", "status", "old_blob", "new_blob", "old_mode", "new_mode", "similarity", "binary"),
    "patch_hunks": lambda x: _parsed(x).heads.select(F.col("key").alias("path"), "hunk_no", "old_start", "old_count", "new_start", "new_count", "heading", "raw_patch_bytes", "patch_hash"),
    "patch_ledger": _patch_ledger,
    "patch_totals": lambda x: _parsed(x).totals.selectExpr("key AS path", "hunk_no", "old_declared", "old_found", "new_declared", "new_found"),
    "patch_errors": _patch_errors,
    "patch_decode": _bytes,
    "path_quoting": _quoting,
    "evidence_markdown": _evidence,
    "evidence_appendix": _appendix,
    "evidence_overview": _overview,
    "patch_source": _patch_source,
    "untracked_files": lambda x: N.untracked(x.files.where("status <> 'added'").select("path"), x.files.select("path", F.coalesce("new_mode", F.lit("100644")).alias("mode"), F.when(F.col("doc_id") % 46 != 0, F.col("text")).otherwise("").alias("content"), F.coalesce("new_blob", F.lit("0" * 40)).alias("object"))),
}

_moved_faults = """CASE WHEN doc_id % 17 = 4 AND side = 'before' THEN span_id WHEN doc_id % 17 = 5 AND side = 'after' THEN 'span_none' ELSE replacement_span_id END"""
_bud = f"""bj0 AS (SELECT *, {sid('omission', 'citation_id')} AS omission_id FROM ci),
bj AS (SELECT *, json_object('content_hash', content_hash, 'end_line', end_line, 'kind', {quote(C.SOURCE_RANGE)}, 'path', path, 'side', side, 'start_line', start_line) AS again FROM bj0),
bs0 AS (SELECT *, CAST(json_object('content_hash', content_hash, 'end_line', end_line, 'id', citation_id, 'omitted', false, 'path', path, 'retrieval', NULL, 'side', side, 'start_line', start_line, 'text', text) AS VARCHAR) AS jf,
  CAST(json_object('content_hash', content_hash, 'end_line', end_line, 'id', citation_id, 'omitted', true, 'path', path, 'retrieval', again, 'side', side, 'start_line', start_line, 'text', NULL) AS VARCHAR) AS jb, CAST(json_object('citation_id', citation_id, 'id', omission_id, 'kind', {quote(C.SOURCE_CONTEXT)}, 'retrieval', again) AS VARCHAR) AS jr FROM bj),
bs AS (SELECT *, length(jf) + 5 * length(regexp_replace(jf, '[\\x00-\\x7F]', '', 'g')) AS "full", length(jb) + 5 * length(regexp_replace(jb, '[\\x00-\\x7F]', '', 'g')) AS bare, length(jr) + 5 * length(regexp_replace(jr, '[\\x00-\\x7F]', '', 'g')) AS "row" FROM bs0),
bt AS (SELECT *, "full" - bare - "row" - 1 AS saves FROM bs),
bo AS (SELECT *, sum("full") OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id) - 1 + {len(C.FRAME)} AS frame, count(*) FILTER (saves > 0) OVER (PARTITION BY doc_id) AS candidates, coalesce(sum("full" - bare) FILTER (saves > 0) OVER (PARTITION BY doc_id), 0) AS all_text, coalesce(sum("row") FILTER (saves > 0) OVER (PARTITION BY doc_id), 0) AS all_rows,
  row_number() OVER w AS k, sum(saves) OVER w AS saved, sum("full" - bare) OVER w AS text_gone, sum("row") OVER w AS rows_made FROM bt WINDOW w AS (PARTITION BY doc_id ORDER BY CASE WHEN saves > 0 THEN saves ELSE 0 END DESC, citation_id ROWS UNBOUNDED PRECEDING)),
"""


def _grow(base: str, times: int) -> str:
    n = base
    for _ in range(4):
        n = f"({base} + {times} * (length(CAST({n} AS VARCHAR)) - 1))"
    return n


def _diagnostic(message, k: str) -> str:
    return f"(length(CAST(json_object('actual_bytes', 0, 'code', {quote(message[0])}, 'message', {quote(message[1])}, 'omitted_contexts', 0, 'requested_bytes', {BUDGET}) AS VARCHAR)) + length(CAST({k} AS VARCHAR)) - 1)"


def _with(k: str, text: str, made: str, message) -> str:
    return f"CAST(frame - {text} + {made} + greatest({k} - 1, 0) + length(CAST({k} AS VARCHAR)) + {_diagnostic(message, k)} AS BIGINT)"


_bud += f"""bp0 AS (SELECT *, CAST(frame + 1 AS BIGINT) AS w0, {_with('candidates', 'all_text', 'all_rows', C.EXCEEDED)} AS f0, {_with('candidates', 'all_text', 'all_rows', C.OMITTED)} AS a0, {_with('k', 'text_gone', 'rows_made', C.OMITTED)} AS s0 FROM bo),
bp AS (SELECT *, {_grow('w0', 1)} AS whole, {_grow('f0', 2)} AS floor_, {_grow('a0', 2)} AS all_omitted, {_grow('s0', 2)} AS size FROM bp0),
bq AS (SELECT *, saves > 0 AND whole - saved - 1 + {_diagnostic(C.OMITTED, 'k')} + length(CAST(whole AS VARCHAR)) - 1 + length(CAST(k AS VARCHAR)) - 1 <= {BUDGET} AS enough FROM bp),
br AS (SELECT *, coalesce(min(k) FILTER (enough) OVER (PARTITION BY doc_id), candidates) AS chosen FROM bq),
bu0 AS (SELECT *, max(size) FILTER (k = chosen) OVER (PARTITION BY doc_id) AS chosen_size FROM br),
bu AS (SELECT *, CASE WHEN whole <= {BUDGET} THEN 'fits' WHEN floor_ > {BUDGET} THEN 'exceeded' WHEN chosen_size <= {BUDGET} THEN 'omitted' ELSE 'omitted_all' END AS outcome FROM bu0),
bud AS (SELECT *, saves > 0 AND CASE outcome WHEN 'fits' THEN false WHEN 'omitted' THEN k <= chosen ELSE true END AS omitted, CAST(CASE outcome WHEN 'fits' THEN whole WHEN 'exceeded' THEN floor_ WHEN 'omitted' THEN chosen_size ELSE all_omitted END AS BIGINT) AS evidence_bytes FROM bu)"""
BUDGETED = f"{BASE}, {_bud}"
#: Bytes that the evidence of the whole comparison may have; the same as above without groups.
WHOLE = 150_000
_whole = f"{BASE}, " + _bud.replace("PARTITION BY doc_id", "").replace(f" {BUDGET}", f" {WHOLE}").replace(f", {BUDGET})", f", {WHOLE})")
_own_hunks = "SELECT doc_id, path, hunk_no, old_start, old_count, new_start, new_count, heading, raw_patch_bytes, patch_hash FROM hunks"
_nested_raw = "'@@ -1 +1 @@' || chr(10) || '-Subproject commit ' || old_blob || chr(10) || '+Subproject commit ' || new_blob || chr(10)"
_all_hunks = f"ah AS ({_own_hunks} UNION ALL SELECT doc_id, path, 1, 1, 1, 1, 1, '', CAST(strlen({_nested_raw}) AS BIGINT), sha256({_nested_raw}) FROM files WHERE rule = 'submodule')"


def _fault_rows() -> str:
    parts = []
    for k, (_, where, error) in FAULTS.items():
        if where == "record 0":
            parts.append(f"SELECT doc_id, CAST(0 AS BIGINT) AS rec, CAST(0 AS BIGINT) AS hunk_no, {quote(error)} AS error FROM files WHERE doc_id % 13 = {k}")
        elif where == "record":
            parts.append(f"SELECT doc_id, 1, 0, {quote(error)} FROM files WHERE doc_id % 13 = {k} AND status <> 'renamed'")
        elif where == "index":
            parts.append(f"SELECT doc_id, 1, 0, {quote(error)} FROM files WHERE doc_id % 13 = {k} AND coalesce(old_blob, new_blob) IS NOT NULL")
        else:
            parts.append(f"SELECT doc_id, 1, hunk_no, {quote(error)} FROM {'hunks' if where == 'own' else 'ah'} WHERE doc_id % 13 = {k}")
    return " UNION ALL ".join(parts)


_tick = lambda c: f"'`' || {c} || '`'"
_markdown = f"""
ms AS (SELECT r.doc_id, r.hunk_id, string_agg('- `' || r.span_id || '` — ' || side || ' ' || start_line || '-' || end_line || '; lines ' || owned || CASE WHEN replacement_span_id IS NULL THEN '' ELSE '; replaces `' || replacement_span_id || '`' END, chr(10) ORDER BY span_no) AS span_text
  FROM rep r JOIN (SELECT span_id, string_agg('`' || line_id || '`', ', ' ORDER BY ordinal) AS owned FROM li GROUP BY span_id) USING (span_id) GROUP BY ALL),
ml AS (SELECT hunk_id, string_agg(CASE WHEN side = 'before' THEN '-' ELSE '+' END || content, chr(10) ORDER BY ordinal) AS diff, string_agg('- `' || line_id || '` — ' || side || ' line ' || line || ' (ordinal ' || ordinal || ')', chr(10) ORDER BY ordinal) AS line_text FROM li GROUP BY hunk_id),
mh AS (SELECT h.doc_id, string_agg(concat_ws(chr(10), '##### Hunk `' || hunk_id || '` (-' || old_start || ',' || old_count || ' +' || new_start || ',' || new_count || ')', '', 'Spans:', span_text, '', '```diff', diff, '```', '', 'Changed lines:', line_text, ''), chr(10) ORDER BY hunk_no) AS hunk_text FROM hunks h JOIN ms USING (hunk_id) JOIN ml USING (hunk_id) GROUP BY h.doc_id),
mu AS (SELECT doc_id, string_agg(concat_ws(chr(10), '#### Unit `' || unit_id || '` (' || kind || ')', '', CASE WHEN metadata <> '{{}}' THEN 'Metadata: `' || metadata || '`' || chr(10) END, CASE WHEN kind = 'text' THEN hunk_text ELSE 'Textual hunks: none.' || chr(10) END), chr(10) ORDER BY unit_no) AS unit_text FROM units LEFT JOIN mh USING (doc_id) GROUP BY doc_id),
mc AS (SELECT doc_id, string_agg('- `' || citation_id || '` — `' || path || '` ' || side || ':' || start_line || '-' || end_line || ' (' || CASE WHEN omitted THEN 'omitted; retrieval retained' ELSE 'included' END || ', sha256 `' || content_hash || '`)', chr(10) ORDER BY side, start_line, citation_id) AS cite_text FROM bud GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), '### `' || coalesce(new_path, old_path) || '`', '', 'Status: ' || status || ' · Classification: ' || classification || ' (' || confidence || ')', '', unit_text, CASE WHEN cite_text IS NOT NULL THEN concat_ws(chr(10), '#### Source citations', '', cite_text, '') END) AS markdown FROM cl JOIN mu USING (doc_id) LEFT JOIN mc USING (doc_id)"""

SQL = {
    "line_scan": f"{BASE} SELECT doc_id, line_no, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS content_hash FROM lines",
    "change_lines": f"{BASE} SELECT doc_id, path, side, line, block, hunk_no, ordinal, content, no_newline FROM ch",
    "hunk_grouping": f"{BASE} SELECT {ID} FROM hunks",
    "span_islands": f"{BASE} SELECT doc_id, hunk_no, span_no, side, start_line, end_line, n_lines FROM spans",
    "replacement_links": f"{BASE} SELECT span_id, side, replacement_span_id FROM rep WHERE replacement_span_id IS NOT NULL",
    "replacement_faults": f"{BASE}, r AS (SELECT span_id, side, {_moved_faults} AS replacement_span_id FROM rep WHERE replacement_span_id IS NOT NULL) SELECT a.span_id, a.replacement_span_id FROM r a LEFT JOIN r b ON a.replacement_span_id = b.span_id WHERE b.span_id IS NULL OR b.side = a.side OR b.replacement_span_id <> a.span_id",
    "stable_ids": f"{BASE} SELECT line_id, span_id, hunk_id, unit_id FROM li",
    "units_nontext": f"{BASE} SELECT unit_id, doc_id, unit_no, kind, metadata FROM units WHERE kind NOT IN ('text', 'unsupported')",
    "units_unsupported": f"{BASE} SELECT unit_id, doc_id, unit_no, kind, metadata FROM units WHERE kind = 'unsupported'",
    "units_text": f"{BASE} SELECT unit_id, doc_id, unit_no, kind, metadata FROM units WHERE kind = 'text'",
    "classify_files": f"{BASE} SELECT doc_id, path, status, classification, confidence FROM cl",
    "formatting_only": f"{BASE} SELECT doc_id, formatting FROM fm",
    "groups_by_class": f"{BASE} SELECT group_class, n AS n_units, digest AS units_hash, {sid('group', 'group_class')} AS group_id FROM {digest('gr0', 'group_class', 'unit_id')}",
    "metrics_by_source": f"{BASE}, r AS (SELECT doc_id, count(*) AS spans, count(replacement_span_id) AS replaced, CAST(sum(CASE WHEN side = 'after' THEN n_lines ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN side = 'before' THEN n_lines ELSE 0 END) AS BIGINT) AS deleted FROM rep GROUP BY doc_id) SELECT source, classification, count(*) AS files, CAST(sum(coalesce(spans, 0)) AS BIGINT) AS spans, CAST(sum(coalesce(added, 0)) AS BIGINT) AS added_lines, CAST(sum(coalesce(deleted, 0)) AS BIGINT) AS deleted_lines, CAST(sum(coalesce(replaced, 0)) AS BIGINT) AS replaced_spans FROM cl LEFT JOIN r USING (doc_id) GROUP BY ALL",
    "inventory_diff": f"{BASE} SELECT doc_id, count(*) FILTER (side = 'before') AS ledger_deleted, count(*) FILTER (side = 'after') AS ledger_added, NOT (doc_id % 41 = 3 AND bool_or(last)) AS equal FROM (SELECT c.*, h.last_kind <> 'keep' AS last FROM ch c JOIN (SELECT doc_id, arg_max(kind, hunk_no * 1000000 + pos) AS last_kind FROM hl GROUP BY doc_id) h USING (doc_id)) GROUP BY doc_id",
    "citations_text": f"{BASE} SELECT citation_id, span_id, path, side, start_line, end_line, content_hash FROM ci",
    "source_hash_check": f"{BASE}, sn AS (SELECT doc_id, side, line, CASE WHEN doc_id % 37 = 2 AND line = 1 THEN content || 'x' ELSE content END AS content FROM snap WHERE NOT (doc_id % 31 = 5 AND line > 3)), e AS (SELECT doc_id, side, max(line) AS last FROM sn GROUP BY ALL) SELECT side, count(*) AS n_lines, count(*) FILTER (sha256(s.content) IS DISTINCT FROM content_hash) AS n_wrong, count(*) FILTER (line > coalesce(last, 0)) AS n_beyond FROM ch LEFT JOIN sn s USING (doc_id, side, line) LEFT JOIN e USING (doc_id, side) GROUP BY side",
    "hierarchy_violations": f"{BASE}, refs AS (SELECT line_id FROM li WHERE ordinal % 7 <> 3 UNION ALL SELECT line_id FROM li WHERE ordinal % 11 = 1), n AS (SELECT line_id, count(*) AS n FROM refs GROUP BY line_id) SELECT l.line_id, coalesce(n, 0) AS n_references FROM li l LEFT JOIN n USING (line_id) WHERE coalesce(n, 0) <> 1",
    "hunk_members": f"{BASE} SELECT DISTINCT hunk_id FROM li WHERE (doc_id + ordinal) % 19 = 4",
    "orphan_references": f"{BASE} SELECT span_id FROM spans WHERE hunk_no % 2 <> 1",
    "id_collisions": f"{BASE} SELECT kind, count(*) AS n_ids, count(DISTINCT id) AS n_distinct FROM (SELECT 'line' AS kind, line_id AS id FROM li UNION ALL SELECT 'line', line_id FROM li WHERE doc_id % 53 = 1 UNION ALL SELECT 'span', span_id FROM spans UNION ALL SELECT 'span', span_id FROM spans WHERE doc_id % 53 = 2 UNION ALL SELECT 'hunk', hunk_id FROM hunks UNION ALL SELECT 'unit', unit_id FROM units) GROUP BY kind",
    "budget_omission": f"{BUDGETED} SELECT citation_id, doc_id, CAST(saves AS BIGINT) AS saves, omitted, outcome, evidence_bytes FROM bud",
    "whole_budget": f"{_whole} SELECT citation_id, doc_id, CAST(saves AS BIGINT) AS saves, omitted, outcome, evidence_bytes FROM bud",
    "omissions": f"{BUDGETED} SELECT omission_id, citation_id, path, side, start_line, end_line, content_hash FROM bud WHERE omitted",
    "changed_paths": f"{BASE} SELECT DISTINCT side, path FROM (SELECT 'before' AS side, old_path AS path FROM files UNION ALL SELECT 'after', new_path FROM files) WHERE path IS NOT NULL",
    "changed_lines": f"{BASE} SELECT side, CASE WHEN side = 'before' THEN old_path ELSE new_path END AS path, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM li GROUP BY ALL",
    "snapshot_digest": f"{BASE}, sh AS (SELECT side, path, sha256(string_agg(content, chr(10) ORDER BY line)) AS h FROM snap GROUP BY ALL), sr AS (SELECT side, coalesce(CASE WHEN side = 'before' THEN old_mode ELSE new_mode END, '') || ':' || h || ':' || path AS r FROM sh JOIN files USING (path)) SELECT side, n AS n_files, digest FROM {digest('sr', 'side', 'r')}",
    "rename_candidates": f"{BASE}, a AS (SELECT sha256(text) AS h, min(path) AS new_path, count(*) AS n FROM files WHERE doc_id % 2 = 0 GROUP BY h), d AS (SELECT sha256(text) AS h, min(path) AS old_path, count(*) AS n FROM files WHERE doc_id % 2 = 1 GROUP BY h) SELECT old_path, new_path FROM a JOIN d USING (h) WHERE a.n = 1 AND d.n = 1",
    "patch_text": f"{BASE}{PATCH} SELECT doc_id, CAST(strlen(patch) AS BIGINT) AS n_bytes, sha256(patch) AS patch_hash FROM pt",
    "patch_parse": f"{BASE} SELECT path, side, line, hunk_no, ordinal, content, content_hash, no_newline FROM ch",
    "patch_source": f"{BASE} SELECT path, side, line, hunk_no, ordinal, content, content_hash, no_newline FROM ch",
    "patch_files": f"{BASE} SELECT path, old_path, new_path, status, old_blob, new_blob, CASE WHEN rule IN ('renamed', 'copied') OR status <> 'added' THEN old_mode END AS old_mode, new_mode, CASE WHEN status IN ('renamed', 'copied') THEN '90%' END AS similarity, \"binary\" FROM files",
    "patch_hunks": f"{BASE}, {_all_hunks} SELECT path, hunk_no, old_start, old_count, new_start, new_count, heading, raw_patch_bytes, patch_hash FROM ah",
    "patch_ledger": f"{BASE} SELECT line_id, span_id, hunk_id, unit_id FROM li",
    "patch_totals": f"{BASE}, {_all_hunks} SELECT path, hunk_no, old_count AS old_declared, old_count AS old_found, new_count AS new_declared, new_count AS new_found FROM ah",
    "patch_errors": f"{BASE}, {_all_hunks} {_fault_rows()}",
    "patch_decode": f"{BASE} SELECT path, line, content || '\\xff' AS content, sha256(encode(content) || unhex('FF')) AS content_hash FROM ch WHERE side = 'after' AND starts_with(content, '+ ')",
    "path_quoting": f"{BASE}, q AS (SELECT doc_id, text || chr(9) || '\"\\' AS p FROM files) SELECT doc_id, CAST(2 + strlen(p) + 3 * (strlen(p) - length(regexp_replace(p, '[^\\x20-\\x7E]', '', 'g'))) + length(regexp_replace(p, '[^\"\\\\]', '', 'g')) AS BIGINT) AS n_quoted, true AS same FROM q",
    "evidence_markdown": f"{BUDGETED}, {_markdown}",
    "untracked_files": f"{BASE}, ut AS (SELECT doc_id, CASE WHEN doc_id % 46 = 0 THEN '' ELSE text END AS t,  path, 'added' AS status, coalesce(new_mode, '100644') AS mode, coalesce(new_blob, repeat('0', 40)) AS object, CASE WHEN doc_id % 46 = 0 OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN eof THEN 0 ELSE 1 END END AS n_lines, 'diff --git \"a/' || path || '\" \"b/' || path || '\"' || chr(10) || 'new file mode ' || coalesce(new_mode, '100644') || chr(10) || 'index ' || repeat('0', 40) || '..' || coalesce(new_blob, repeat('0', 40)) || chr(10) AS header FROM files WHERE status = 'added') SELECT path, status, mode, object, n_lines, header, header || CASE WHEN t = '' THEN '' ELSE '--- /dev/null' || chr(10) || '+++ \"b/' || path || '\"' || chr(10) || '@@ -0,0 +1' || CASE WHEN n_lines = 1 THEN '' ELSE ',' || n_lines END || ' @@' || chr(10) || '+' || replace(rtrim_, chr(10), chr(10) || '+') || chr(10) || CASE WHEN ends_with(t, chr(10)) THEN '' ELSE {quote(L.MARKER)} || chr(10) END END AS patch FROM (SELECT *, CASE WHEN ends_with(t, chr(10)) THEN t[1:-2] ELSE t END AS rtrim_ FROM ut)",
}
