"""The ledger of a table folder as lazy relations, and the same as common table expressions of DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..operators import citations as C
from ..operators import ledger as L
from ..operators import patch as P
from ..sources import substrate as S
from ..sources.tables import table, written_by

BUDGET = 4000


class Ledger:
    """The relations of one comparison, each built when first asked for."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self._stored = spark, sf_dir, set()
        self.files, self.lines, self.placed, self.hunk_lines = S.substrate(spark, sf_dir)

    def table(self, name):
        return table(self.spark, self.sf_dir, name)

    def dealt(self, df, name):
        """df written once, in buckets by doc_id that lie as the files do."""
        return written_by(self.spark, df, name, "doc_id", S.shares(self.spark, self.sf_dir))

    def store(self, *names):
        """Writes the files and these relations once, for queries that use them in many branches; from then on they are read."""
        if not self._stored:
            self._stored.add("files")
            self.files = self.dealt(self.files, "files")
            self.lines, self.placed, self.hunk_lines = S.of_files(self.files)
        for name in names:
            if name not in self._stored:
                self.__dict__[name] = self.dealt(getattr(self, name), name)
                self._stored.add(name)
        return self

    changes = cached_property(lambda self: S.changes(self.hunk_lines))
    hunks = cached_property(lambda self: L.hunks(self.hunk_lines, self.files))
    changed = cached_property(lambda self: L.changed(self.hunks))
    #: The same lines as changed, without their ids and texts, from hunks where these are written.
    lines_changed = cached_property(lambda self: (self.changed if "hunks" in self._stored else self.changes).select("doc_id", "side", "line"))
    spans = cached_property(lambda self: L.spans(self.changed))
    linked = cached_property(lambda self: L.replacements(self.spans))
    ids = cached_property(lambda self: L.line_rows(self.spans))
    units = cached_property(lambda self: L.units(self.files, self.hunks))
    classes = cached_property(lambda self: L.classified(self.files, self.hunks, self.units))
    groups = cached_property(lambda self: L.groups(self.units, self.classes))
    snapshot = cached_property(lambda self: C.snapshot_lines(self.placed))
    cited = cached_property(lambda self: C.citations(self.spans, self.snapshot))
    budgeted = cached_property(lambda self: C.budget(self.cited, BUDGET))
    #: Budgeted citations without their texts.
    outcomes = cached_property(lambda self: self.budgeted.select("doc_id", "omitted", "outcome"))
    patches = cached_property(lambda self: P.write_patch(self.files, self.hunks))
    #: Texts of both sides, for files of any length.
    texts = cached_property(lambda self: self.snapshot.groupBy("doc_id", "side").agg(L.listed(F.array_sort(F.collect_list(F.struct("line", "content"))), "content", "\n").alias("text")))


def sid(kind: str, *fields: str) -> str:
    return f"('{kind}_' || substr(sha256('{kind}/v1' || chr(10) || CAST(to_json([{', '.join(f'CAST({f} AS VARCHAR)' for f in fields)}]) AS VARCHAR)), 1, 24))"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def digest(rows: str, by: str, value: str) -> str:
    """Two-level digest of value in the relation rows, as operators.ledger.digest."""
    return (
        f"(SELECT {by}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY _b, h)) AS digest FROM (SELECT {by}, CAST('0x' || substr(sha256({value}), 1, 4) AS BIGINT) % 256 AS _b, count(*) AS n, sha256(string_agg({value}, chr(10) ORDER BY {value})) AS h FROM {rows} GROUP BY ALL) GROUP BY {by})"
    )


_rule = "CASE CAST(doc_id % 23 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.STATUS.items()) + " ELSE 'modified' END"
_place = lambda i: f"CASE CAST(doc_id % {len(S.PLACES)} AS INTEGER) " + " ".join(f"WHEN {k} THEN '{p.split('|')[i]}'" for k, p in enumerate(S.PLACES)) + " END"
_up = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_order = "PARTITION BY doc_id ORDER BY line_no, CASE WHEN kind = 'after' THEN 1 ELSE 0 END"
_back = "PARTITION BY doc_id ORDER BY line_no DESC, CASE WHEN kind = 'after' THEN 1 ELSE 0 END DESC"
_behind = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_identity = ", ".join(L.IDENTITY)
_blank = BLANK.replace("'", "''")
_names = lambda xs: "(" + ", ".join(quote(x) for x in xs) + ")"
_within = lambda *xs: f"list_has_any(parts, [{', '.join(quote(x) for x in xs)}])"
_range = lambda a, b: f"{a} || CASE WHEN {b} = 1 THEN '' ELSE ',' || {b} END"
_class = f"""CASE WHEN list_contains(kinds, 'unsupported') THEN 'unsupported' WHEN list_contains(kinds, 'binary') THEN 'binary' WHEN list_contains(kinds, 'rename') THEN 'rename' WHEN status = 'added' THEN 'added' WHEN status = 'deleted' THEN 'deleted'
  WHEN kinds = ['mode'] THEN 'mode' WHEN NOT list_contains(kinds, 'text') THEN 'structural' WHEN name IN {_names(L.LOCKFILES + L.DEPENDENCIES)} THEN 'dependency'
  WHEN {_within('generated')} OR ends_with(name, '.min.js') OR ends_with(name, '.min.css') THEN 'generated' WHEN suffix = '.schema' OR {_within('schema')} OR (contains(name, 'schema') AND suffix IN {_names(L.SCHEMA_SUFFIXES)}) THEN 'schema'
  WHEN name IN {_names(L.CONFIG_NAMES)} OR {_within('.github')} OR suffix IN {_names(L.CONFIG_SUFFIXES)} OR (starts_with(name, '.') AND ends_with(name, 'rc')) THEN 'configuration'
  WHEN {_within('test', 'tests')} OR starts_with(name, 'test_') OR contains(name, '.test.') THEN 'tests' WHEN {_within('docs')} OR suffix IN {_names(L.DOC_SUFFIXES)} THEN 'docs' WHEN coalesce(formatting, false) THEN 'formatting' WHEN suffix IN {_names(L.SOURCE_SUFFIXES)} THEN 'behavioral' ELSE 'unresolved' END"""

BASE = f"""
WITH RECURSIVE f0 AS (SELECT doc_id, source, text, {_rule} AS rule, coalesce(source, 'none') || '/' || {_place(0)} || '/doc_' || doc_id || {_place(1)} AS path FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
files AS (SELECT doc_id, source, text, path, rule, CASE WHEN rule IN ('mode', 'binary', 'submodule') THEN 'modified' ELSE rule END AS status,
  CASE WHEN rule <> 'added' THEN CASE WHEN rule IN ('renamed', 'copied') THEN path || '.orig' ELSE path END END AS old_path, CASE WHEN rule <> 'deleted' THEN path END AS new_path,
  CASE WHEN rule <> 'added' THEN CASE WHEN rule = 'submodule' THEN '160000' ELSE '100644' END END AS old_mode, CASE WHEN rule <> 'deleted' THEN CASE rule WHEN 'submodule' THEN '160000' WHEN 'mode' THEN '100755' ELSE '100644' END END AS new_mode,
  CASE WHEN rule NOT IN ('added', 'mode') THEN substr(sha256('old:' || text), 1, 40) END AS old_blob, CASE WHEN rule NOT IN ('deleted', 'mode') THEN substr(sha256('new:' || text), 1, 40) END AS new_blob, rule = 'binary' AS "binary",
  CASE WHEN rule IN ('added', 'deleted') THEN rule WHEN rule IN ('mode', 'binary', 'submodule') THEN 'none' WHEN doc_id % 29 = 6 THEN 'spaces' ELSE 'lines' END AS edit, NOT ends_with(text, chr(10)) AS eof FROM f0),
l0 AS (SELECT doc_id, path, edit, eof, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS m FROM files),
lines AS (SELECT doc_id, path, edit, eof, m - CASE WHEN eof THEN 0 ELSE 1 END AS n, CAST(line_no AS BIGINT) AS line_no, content, (doc_id * 31 + line_no) % 11 AS k FROM l0 WHERE NOT (line_no = m AND content = '')),
l1 AS (SELECT *, eof AND line_no = m2 AND NOT (edit = 'lines' AND k = 2) AS no_newline FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS m2 FROM lines)),
ev AS (
  SELECT doc_id, path, line_no, 'keep' AS kind, content, no_newline FROM l1 WHERE edit = 'none' OR (edit = 'spaces' AND NOT (k = 1 AND content LIKE '% %')) OR (edit = 'lines' AND k NOT IN (0, 1))
  UNION ALL SELECT doc_id, path, line_no, 'before', content, no_newline FROM l1 WHERE edit = 'deleted' OR (edit = 'spaces' AND k = 1 AND content LIKE '% %') OR (edit = 'lines' AND k IN (0, 1))
  UNION ALL SELECT doc_id, path, line_no, 'after', CASE WHEN edit = 'added' THEN content WHEN edit = 'spaces' THEN replace(content, ' ', '  ') WHEN k = 1 THEN content || ' ~' ELSE '+ ' || content END, no_newline
    FROM l1 WHERE edit = 'added' OR (edit = 'spaces' AND k = 1 AND content LIKE '% %') OR (edit = 'lines' AND k IN (1, 2))),
p0 AS (SELECT *, CAST(sum(CASE WHEN kind = 'keep' THEN 1 ELSE 0 END) OVER ({_order} {_up}) AS BIGINT) AS block, CAST(sum(CASE WHEN kind <> 'after' THEN 1 ELSE 0 END) OVER ({_order} {_up}) AS BIGINT) AS old_line, CAST(sum(CASE WHEN kind <> 'before' THEN 1 ELSE 0 END) OVER ({_order} {_up}) AS BIGINT) AS new_line FROM ev),
snap AS (SELECT doc_id, path, 'before' AS side, old_line AS line, content FROM p0 WHERE kind <> 'after' UNION ALL SELECT doc_id, path, 'after', new_line, content FROM p0 WHERE kind <> 'before'),
p1 AS (SELECT *, last_value(CASE WHEN kind <> 'keep' THEN block END IGNORE NULLS) OVER ({_order} {_behind}) AS gone, last_value(CASE WHEN kind <> 'keep' THEN block END IGNORE NULLS) OVER ({_back} {_behind}) AS coming FROM p0),
p2 AS (SELECT *, CAST(sum(CASE WHEN kind <> 'keep' AND (gone IS NULL OR block - gone > 6) THEN 1 ELSE 0 END) OVER ({_order} {_up}) AS BIGINT) AS begun FROM p1),
p3 AS (SELECT *, CASE WHEN kind <> 'keep' OR block - gone <= 3 OR coming - gone <= 6 THEN begun WHEN coming - block < 3 THEN begun + 1 END AS hunk_no FROM p2),
hl AS (SELECT doc_id, path, kind, content, no_newline, block, old_line, new_line, hunk_no, row_number() OVER (PARTITION BY doc_id, hunk_no ORDER BY block, CASE kind WHEN 'keep' THEN 0 WHEN 'before' THEN 1 ELSE 2 END, CASE WHEN kind = 'after' THEN new_line ELSE old_line END) - 1 AS pos FROM p3 WHERE hunk_no IS NOT NULL),
ch AS (SELECT doc_id, path, kind AS side, CASE WHEN kind = 'before' THEN old_line ELSE new_line END AS line, block, hunk_no, row_number() OVER (PARTITION BY doc_id, hunk_no ORDER BY pos) - 1 AS ordinal, content, sha256(content) AS content_hash, no_newline FROM hl WHERE kind <> 'keep'),
h0 AS (SELECT doc_id, path, hunk_no, coalesce(min(old_line) FILTER (kind <> 'after'), min(old_line)) AS old_start, count(*) FILTER (kind <> 'after') AS old_count, coalesce(min(new_line) FILTER (kind <> 'before'), min(new_line)) AS new_start, count(*) FILTER (kind <> 'before') AS new_count,
  count(DISTINCT block) FILTER (kind <> 'keep') AS n_blocks, 'section ' || hunk_no AS heading, string_agg(CASE kind WHEN 'keep' THEN ' ' WHEN 'before' THEN '-' ELSE '+' END || content || chr(10) || CASE WHEN no_newline THEN {quote(L.MARKER)} || chr(10) ELSE '' END, '' ORDER BY pos) AS body FROM hl GROUP BY doc_id, path, hunk_no),
h1 AS (SELECT *, '@@ -' || {_range('old_start', 'old_count')} || ' +' || {_range('new_start', 'new_count')} || ' @@ ' || heading || chr(10) || body AS raw FROM h0),
h2 AS (SELECT *, sha256(raw) AS patch_hash, CAST(strlen(raw) AS BIGINT) AS raw_patch_bytes FROM h1),
fh AS (SELECT doc_id, sha256(string_agg(patch_hash, ',' ORDER BY hunk_no)) AS file_hash FROM h2 GROUP BY doc_id),
hunks AS (SELECT h2.*, old_path, new_path, file_hash, {sid('unit', *L.IDENTITY, "'text'", 'file_hash')} AS unit_id, {sid('hunk', 'old_path', 'new_path', 'old_blob', 'new_blob', 'status', 'old_start', 'old_count', 'new_start', 'new_count', 'patch_hash')} AS hunk_id FROM h2 JOIN fh USING (doc_id) JOIN files USING (doc_id)),
lc AS (SELECT c.*, h.old_path, h.new_path, h.unit_id, h.hunk_id FROM ch c JOIN hunks h USING (doc_id, hunk_no)),
s0 AS (SELECT *, CASE WHEN lag(block) OVER w = block AND lag(side) OVER w = side AND lag(line) OVER w = line - 1 THEN 0 ELSE 1 END AS cut FROM lc WINDOW w AS (PARTITION BY doc_id, hunk_no ORDER BY ordinal)),
s1 AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY doc_id, hunk_no ORDER BY ordinal {_up}) - 1 AS BIGINT) AS span_no FROM s0),
s2 AS (SELECT doc_id, path, old_path, new_path, hunk_no, unit_id, hunk_id, span_no, block, side, min(line) AS start_line, max(line) AS end_line, count(*) AS n_lines, string_agg(line || ':' || ordinal || ':' || content_hash, ',' ORDER BY ordinal) AS members FROM s1 GROUP BY ALL),
spans AS (SELECT *, {sid('span', 'unit_id', 'hunk_id', 'side', 'start_line', 'end_line', 'span_no', 'members')} AS span_id FROM s2),
rep AS (SELECT *, CASE WHEN side = 'before' AND lead(block) OVER w = block AND lead(side) OVER w = 'after' THEN lead(span_id) OVER w WHEN side = 'after' AND lag(block) OVER w = block AND lag(side) OVER w = 'before' THEN lag(span_id) OVER w END AS replacement_span_id FROM spans WINDOW w AS (PARTITION BY doc_id, hunk_no ORDER BY span_no)),
li AS (SELECT a.*, s.span_id, {sid('line', 'a.unit_id', 'a.hunk_id', 's.span_id', 'a.side', 'line', 'ordinal', 'content_hash', 'no_newline')} AS line_id FROM s1 a JOIN spans s USING (doc_id, hunk_no, span_no)),
oh AS (SELECT doc_id, list(hunk_id ORDER BY hunk_id) AS open_hunks FROM hunks WHERE contains(body, chr(10) || {quote(L.MARKER)}) GROUP BY doc_id),
u0 AS (SELECT f.*, file_hash, open_hunks, coalesce(old_mode, '') = '160000' OR coalesce(new_mode, '') = '160000' AS nested FROM files f LEFT JOIN fh USING (doc_id) LEFT JOIN oh USING (doc_id)),
u1 AS (SELECT *, list_filter([CASE WHEN file_hash IS NOT NULL AND NOT nested THEN 'text' END, CASE WHEN "binary" THEN 'binary' END, CASE WHEN old_mode IS DISTINCT FROM new_mode THEN 'mode' END, CASE WHEN status = 'renamed' THEN 'rename' END, CASE WHEN status = 'copied' THEN 'copy' END, CASE WHEN nested THEN 'submodule' END], lambda x: x IS NOT NULL) AS own_kinds FROM u0),
u2 AS (SELECT * EXCLUDE (own_kinds), unnest(CASE WHEN len(own_kinds) > 0 THEN own_kinds ELSE ['unsupported'] END) AS kind, generate_subscripts(CASE WHEN len(own_kinds) > 0 THEN own_kinds ELSE ['unsupported'] END, 1) AS unit_no FROM u1),
units AS (SELECT *, {sid('unit', *L.IDENTITY, 'kind', "CASE WHEN kind = 'text' THEN file_hash END")} AS unit_id, CAST(CASE kind WHEN 'text' THEN CASE WHEN open_hunks IS NULL THEN '{{}}'::JSON ELSE json_object('no_newline', open_hunks) END WHEN 'binary' THEN json_object('binary', true) WHEN 'mode' THEN json_object('new_mode', new_mode, 'old_mode', old_mode)
  WHEN 'rename' THEN json_object('new_path', new_path, 'old_path', old_path) WHEN 'copy' THEN json_object('new_path', new_path, 'old_path', old_path) WHEN 'submodule' THEN json_object('new_object', new_blob, 'old_object', old_blob) ELSE json_object({', '.join(f"'{c}', {c}" for c in sorted(L.IDENTITY))}) END AS VARCHAR) AS metadata FROM u2),
fm0 AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY hunk_no, ordinal) FILTER (side = 'before') AS b, string_agg(content, chr(10) ORDER BY hunk_no, ordinal) FILTER (side = 'after') AS a FROM ch GROUP BY doc_id),
fm AS (SELECT doc_id, coalesce(a <> b AND regexp_replace(a, '{_blank}', '', 'g') = regexp_replace(b, '{_blank}', '', 'g'), false) AS formatting FROM fm0),
c0 AS (SELECT f.*, formatting, kinds, list_transform(string_split(coalesce(new_path, old_path), '/'), lambda x: lower(x)) AS parts, lower(string_split(coalesce(new_path, old_path), '/')[-1]) AS name, lower(regexp_extract(string_split(coalesce(new_path, old_path), '/')[-1], '^.+(\\.[^./]+)$', 1)) AS suffix
  FROM files f JOIN (SELECT doc_id, list(kind) AS kinds FROM units GROUP BY doc_id) USING (doc_id) LEFT JOIN fm USING (doc_id)),
classes AS (SELECT *, {_class} AS classification FROM c0),
cl AS (SELECT *, CASE WHEN classification IN ('unsupported', 'binary', 'rename', 'added', 'deleted', 'mode', 'structural', 'dependency') THEN 'extracted' WHEN classification = 'unresolved' THEN 'unresolved' ELSE 'inferred' END AS confidence FROM classes),
ci0 AS (SELECT s.doc_id, s.side, CASE WHEN s.side = 'before' THEN s.old_path ELSE s.new_path END AS path, s.span_id, s.start_line, s.end_line, string_agg(n.content, chr(10) ORDER BY n.line) AS text FROM spans s JOIN snap n ON s.doc_id = n.doc_id AND s.side = n.side AND n.line BETWEEN s.start_line AND s.end_line GROUP BY ALL),
ci1 AS (SELECT span_id, string_agg(line_id, ',' ORDER BY ordinal) AS cited FROM li GROUP BY span_id),
ci AS (SELECT *, sha256(text) AS content_hash, {sid('source', 'path', 'side', 'start_line', 'end_line', 'cited')} AS citation_id FROM ci0 JOIN ci1 USING (span_id)),
gr0 AS (SELECT CASE WHEN kind IN ('binary', 'mode', 'rename', 'unsupported') THEN kind WHEN kind IN ('copy', 'submodule') THEN 'structural' ELSE classification END AS group_class, unit_id FROM units JOIN (SELECT doc_id, classification FROM cl) USING (doc_id))
"""

#: The patch text of each file, as operators.patch.write_patch.
_name = lambda c, p="": f"CASE WHEN doc_id % 7 = 3 THEN '\"{p}' || {c} || '\"' ELSE '{p}' || {c} END"
_old, _new = "coalesce(old_path, new_path)", "coalesce(new_path, old_path)"
_moved = lambda word: f"'similarity index 90%' || chr(10) || '{word} from ' || {_name('old_path')} || chr(10) || '{word} to ' || {_name('new_path')} || chr(10)"
PATCH = f""", pb AS (SELECT doc_id, string_agg(raw, '' ORDER BY hunk_no) AS body FROM hunks GROUP BY doc_id),
pf AS (SELECT f.*, CASE WHEN rule = 'submodule' THEN '@@ -1 +1 @@' || chr(10) || '-Subproject commit ' || old_blob || chr(10) || '+Subproject commit ' || new_blob || chr(10) ELSE body END AS body FROM files f LEFT JOIN pb USING (doc_id)),
pt AS (SELECT doc_id, path, 'diff --git ' || {_name(_old, 'a/')} || ' ' || {_name(_new, 'b/')} || chr(10)
  || CASE status WHEN 'added' THEN 'new file mode ' || new_mode || chr(10) WHEN 'deleted' THEN 'deleted file mode ' || old_mode || chr(10) WHEN 'renamed' THEN {_moved('rename')} WHEN 'copied' THEN {_moved('copy')} ELSE CASE WHEN old_mode <> new_mode THEN 'old mode ' || old_mode || chr(10) || 'new mode ' || new_mode || chr(10) ELSE '' END END
  || CASE WHEN coalesce(old_blob, new_blob) IS NULL THEN '' ELSE 'index ' || coalesce(old_blob, repeat('0', 40)) || '..' || coalesce(new_blob, repeat('0', 40)) || CASE WHEN old_mode = new_mode THEN ' ' || old_mode ELSE '' END || chr(10) END
  || CASE WHEN "binary" THEN 'Binary files ' || {_name(_old, 'a/')} || ' and ' || {_name(_new, 'b/')} || ' differ' || chr(10) WHEN body IS NULL THEN '' ELSE CASE WHEN old_path IS NULL THEN '--- /dev/null' ELSE '--- ' || {_name(_old, 'a/')} END || chr(10) || CASE WHEN new_path IS NULL THEN '+++ /dev/null' ELSE '+++ ' || {_name(_new, 'b/')} END || chr(10) || body END AS patch FROM pf)"""
