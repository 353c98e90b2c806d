"""Queries over symbols, graph facts and closures."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.symbols import BRACES, SUPPORTED, brace_symbols, code_uses, declared, python_symbols, symbol_scan, symbol_table, unparsed
from ..operators import citations as C
from ..operators import graph as G
from ..sources import code as S
from ..sources import snapshot as N
from ..sources.tables import written
from .base import BASE, PATCH, quote, sid
from .ledgers import BUDGETED

FACT = ", ".join(G.FACT)


class Graph:
    """Symbols and facts of one side."""

    def __init__(self, ledger, side="after"):
        self.x, self.side, self.own, self._stored = ledger, side, "new_path" if side == "after" else "old_path", set()

    def store(self, *names):
        """Writes these relations once, by file, but for facts, which have paths only; from then on they are read."""
        self.x.store()
        for name in names:
            if name not in self._stored:
                self.__dict__[name] = written(self.x.spark, self.found, name) if name == "found" else self.x.dealt(getattr(self, name), name)
                self._stored.add(name)
        return self

    @cached_property
    def sources(self):
        if self.side == "after":
            return S.sources(self.x.files, self.x.lines)
        there = self.x.files.where("old_path IS NOT NULL").select("doc_id", F.col("old_path").alias("path"), F.col("old_path").alias("new_path"))
        lines = self.x.placed.where("kind <> 'after'").select("doc_id", F.col("old_line").alias("line_no"), "content").join(there.select("doc_id", "path").hint("merge"), "doc_id")
        return S.sources(there, lines)

    scan = cached_property(lambda self: symbol_scan(self.sources))
    symbols = cached_property(lambda self: symbol_table(self.sources, self.scan))
    ranged = cached_property(lambda self: self.symbols.where("end_line IS NOT NULL"))
    broken = cached_property(lambda self: unparsed(self.sources, self.scan))
    #: Changed lines; every 19th document has one more, far beyond its end.
    changed = cached_property(lambda self: self.x.lines_changed.where(F.col("side") == self.side).select("doc_id", "line").unionByName(self.x.files.where(f"doc_id % 19 = 8 AND {self.own} IS NOT NULL").select("doc_id", F.lit(1_000_000).cast("long").alias("line"))).distinct())
    #: All files of the side; those of other languages have no text here.
    files = cached_property(lambda self: self.x.files.where(f"{self.own} IS NOT NULL").select("doc_id", F.col(self.own).alias("path")).join(self.sources.select("doc_id", "n_lines").hint("merge"), "doc_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))))
    found = cached_property(lambda self: G.file_facts(self.files, self.changed, self.symbols, self.broken, self.side))
    #: Calls as the texts have them.
    calls = cached_property(lambda self: code_uses(self.sources).where("kind = 'call' AND caller IS NOT NULL").join(self.files.select("doc_id", "path").hint("merge"), "doc_id").select("caller", F.col("name").alias("callee"), "path").distinct())
    definitions = cached_property(lambda self: self.symbols.join(self.files.select("doc_id", "path").hint("merge"), "doc_id").select("name", "path", "line"))
    #: Names that are looked up: those of changed symbols, and one that there isn't.
    names = cached_property(lambda self: self.found.where("kind IN ('changed_symbol', 'enclosing_symbol')").select("symbol").distinct().unionByName(self.x.spark.sql("SELECT 'f_none' AS symbol")))
    parsed = cached_property(lambda self: self.found.where("kind = 'definition'").select(F.col("symbol").alias("name"), "path", "line"))

    @cached_property
    def impact(self):
        """Every 11th path is missing from the snapshot."""
        there = self.files.where("doc_id % 11 <> 6").select("path", "n_lines")
        return G.impact_facts(self.names, self.definitions, self.parsed, G.call_edges(self.calls), there, "after")

    enriched = cached_property(lambda self: G.enrich(self.found, self.impact, self.x.files.where("new_path IS NOT NULL").select("path"), "after"))


def graph(x) -> Graph:
    if not hasattr(x, "_graph"):
        x._graph = Graph(x)
    return x._graph


def stored(x) -> Graph:
    """The graph with its symbols, changed lines and facts written once, for queries that use them in many branches."""
    return read(x).store("found")


def read(x) -> Graph:
    """The graph with its symbols and changed lines written once."""
    return graph(x).store("sources", "scan", "changed")


def _pages(x):
    return x.table("pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()


def _blast(x):
    e = _pages(x)
    return G.neighbours(e.selectExpr("dst AS symbol").unionByName(e.selectExpr("src AS symbol")).distinct(), e)


def _sides(x):
    """The facts of both sides merged, each built from its own texts and changed lines."""
    before = Graph(x, "before").store("sources", "scan", "changed")
    return G.merged(before.found, stored(x).found)


def _source_calls(x):
    g = graph(x)
    return code_uses(g.sources).where("kind = 'call'").join(g.files.select("doc_id", "path"), "doc_id").select("doc_id", "path", "caller", F.col("name").alias("callee"), "line")


def _merged(x):
    """Both halves of the facts; every 13th line's facts have another target in the second one, under the same id."""
    f = stored(x).found
    return G.merged(f.where("coalesce(line, 0) % 2 = 0"), f.where("coalesce(line, 0) % 3 = 0").withColumn("target", F.expr("IF(line % 13 = 0, 'x', target)")))


def _received(x):
    """Facts as received: in order, but every 7th a place later, every 29th twice, and every 31st with another symbol under its id."""
    at = stored(x).found.selectExpr("*", "path AS result", "row_number() OVER (PARTITION BY path ORDER BY coalesce(line, 0), kind, coalesce(symbol, ''), coalesce(target, ''), fact_id) AS n")
    moved = at.selectExpr(*G.FACT, "fact_id", "result", "IF(n % 7 = 0, n * 10 + 15, n * 10) AS pos", "n")
    twice = moved.where("n % 29 = 0").withColumn("pos", F.col("pos") + 1)
    return moved.withColumn("symbol", F.expr("IF(n % 31 = 0, 'forged', symbol)")).unionByName(twice).drop("n")


def _invalid(x):
    """Facts with fields that no fact has, by row number."""
    at = stored(x).found.selectExpr(*G.FACT, "path AS result", "row_number() OVER (PARTITION BY path ORDER BY coalesce(line, 0), kind, coalesce(symbol, ''), fact_id) AS pos")
    bad = lambda k, c, value: f"IF(pos % 6 = {k}, {value}, {c}) AS {c}"
    return G.invalid_facts(at.selectExpr("result", "pos", bad(0, "kind", "'guess'"), bad(1, "side", "'both'"), bad(2, "path", "concat('/', path)"), bad(3, "line", "0L"), bad(4, "confidence", "'sure'"), bad(5, "provenance", "''"), "symbol", "target"))


def _results(x):
    """Graph results of both sides, by document."""
    pick = lambda by: f"element_at(array('available', 'unavailable', 'disabled'), CAST({by} % 3 AS INT) + 1)"
    rows = x.files.selectExpr("doc_id AS id", f"{pick('doc_id')} AS before_status", f"{pick('doc_id div 3')} AS after_status", "IF(doc_id % 5 = 0, 'a', 'b') AS before_provider", "IF(doc_id % 7 = 0, 'a', 'b') AS after_provider", "IF(doc_id % 4 = 0, NULL, '1') AS before_version", "IF(doc_id % 6 = 0, NULL, '1') AS after_version", "IF(doc_id % 8 = 0, NULL, concat('k', doc_id)) AS before_cache_key", "IF(doc_id % 3 = 0, NULL, concat('k', doc_id)) AS after_cache_key", "doc_id % 2 AS before_diagnostics", "doc_id % 5 AS after_diagnostics")
    return G.merged_results(rows)


def _references(x):
    """References to paths and lines, some of which there aren't."""
    rows = x.files.selectExpr("doc_id AS id", "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('./', path) WHEN 1 THEN concat('../', path) WHEN 2 THEN path ELSE concat(path, 'x') END AS path", "IF(doc_id % 3 = 0, NULL, doc_id % 50) AS line")
    return N.invalid_references(rows, x.lines.groupBy("path").agg(F.count("*").alias("n_lines")))


def _values(x):
    """Confidences, parsers and line numbers as they may come."""
    rows = x.table("events").selectExpr("event_id", "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN ' Extracted ' WHEN 1 THEN 'inferred' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN event_type ELSE NULL END AS sure", "IF(event_id % 2 = 0, 'regex', 'tree') AS parser", "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'true' WHEN 2 THEN '0' ELSE concat('-', event_id) END AS line")
    sure = G.confidence(F.col("sure"))
    return rows.select("event_id", sure.alias("confidence"), G.parser_confidence(sure, F.col("parser")).alias("by_parser"), G.line_number(F.col("line")).alias("line"))


def _parents(x):
    part = x.table("part")
    half = part.where("p_partkey >= 2").selectExpr("p_partkey AS node", "p_partkey div 2 AS parent")
    return half.unionByName(part.where("p_partkey >= 10 AND p_partkey % 5 = 0").selectExpr("p_partkey AS node", "p_partkey - 3 AS parent")).distinct()


def _closure(x):
    return G.ancestors(x.spark, _parents(x)).groupBy("node").agg(F.count("*").alias("n_reached"), F.min("ancestor").alias("lowest"))


def _merge_base(x):
    e = _parents(x)
    return G.merge_bases(x.spark, e, e.selectExpr("node AS left_node", "node + 7 AS right_node").distinct())


def _index(x):
    """Graph indexes of files: every 5th manifest names another provider, every 7th payload has changed."""
    key = N.index_key(F.col("path"), F.sha2("text", 256))
    rows = x.files.select(key.alias("key"), F.sha2("text", 256).alias("snapshot"), "doc_id")
    manifests = rows.select("key", "snapshot", F.when(F.col("doc_id") % 5 == 0, "other").otherwise("symbols").alias("provider"), F.col("snapshot").alias("payload_hash")).where("doc_id % 9 <> 0")
    payloads = rows.select("key", F.when(F.col("doc_id") % 7 == 0, F.sha2("key", 256)).otherwise(F.col("snapshot")).alias("content_hash"))
    return N.usable_index(manifests, rows.select("key", "snapshot", F.lit("symbols").alias("provider")), payloads)


BUILD = {
    "python_symbols": lambda x: python_symbols(graph(x).sources.where("path LIKE '%.py'").select("doc_id", "text")).drop("text"),
    "brace_symbols": lambda x: brace_symbols(graph(x).sources.where(S.is_brace()), declared(graph(x).sources.where(S.is_brace())).drop("source", "column")),
    "symbol_table": lambda x: graph(x).symbols,
    "range_containment": lambda x: G.enclosing(graph(x).changed, graph(x).ranged).select("doc_id", "line", "name", "start", "stop"),
    "innermost_symbol": lambda x: G.innermost(graph(x).changed, graph(x).ranged),
    "unresolved_lines": lambda x: G.innermost(graph(x).changed, graph(x).ranged).where("symbol IS NULL").groupBy("doc_id").agg(F.count("*").alias("n_unresolved")),
    "graph_file_facts": lambda x: read(x).found.select("fact_id", *G.FACT),
    "graph_impact": lambda x: stored(x).impact.select("fact_id", *G.FACT),
    "graph_enrich": lambda x: stored(x).enriched.groupBy("kind", "confidence").agg(F.count("*").alias("n_facts"), F.count_distinct("fact_id").alias("n_ids")),
    "graph_incomplete": lambda x: G.incomplete(stored(x).enriched).groupBy("kind", "confidence").agg(F.count("*").alias("n")),
    "fact_order": lambda x: G.in_order(stored(x).found).select("fact_id", "side_rank", "path", F.col("n").cast("long").alias("n")),
    "fact_faults": lambda x: G.order_faults(_received(x)).groupBy("result", "error").agg(F.count("*").alias("n")),
    "fact_fields": _invalid,
    "fact_merge": _merged,
    "graph_both_sides": _sides,
    "source_calls": _source_calls,
    "fact_place": lambda x: G.in_whole_order(stored(x).found).select("fact_id", F.col("n").cast("long").alias("n")),
    "id_recompute": lambda x: _received(x).select("fact_id", (F.col("fact_id") == stable_id("fact", *G.FACT)).alias("same")).groupBy("same").agg(F.count("*").alias("n")),
    "graph_status_merge": _results,
    "graph_references": _references,
    "graph_values": _values,
    "graph_index": _index,
    "blast_radius": _blast,
    "dependency_closure": _closure,
    "merge_base": _merge_base,
}

_suffixes = lambda xs: "(" + ", ".join(f"'{s}'" for s in xs) + ")"
_end = "lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^./]+)$', 1))"
_fact = sid("fact", *G.FACT)
GRAPH = f"""
co AS (SELECT l.doc_id, l.path, l.line_no, 'f' || (7 * l.doc_id + line_no) % {S.NAMES} AS caller, 'f' || (3 * l.doc_id + 5 * line_no) % {S.NAMES} AS callee, {_end.replace('path', 'l.path')} AS suffix FROM lines l JOIN files f ON f.doc_id = l.doc_id AND f.new_path IS NOT NULL),
cs AS (SELECT * FROM co WHERE suffix IN {_suffixes(SUPPORTED)}),
cf AS (SELECT doc_id, path, suffix, 3 * count(*) + CASE WHEN doc_id % 17 = 4 THEN 1 ELSE 0 END AS n_lines FROM cs GROUP BY doc_id, path, suffix),
sy AS (SELECT doc_id, path, caller AS name, 3 * line_no - 2 AS line, CASE WHEN suffix <> '.py' AND doc_id % 17 = 4 THEN NULL ELSE 3 * line_no END AS end_line, CASE WHEN suffix = '.py' THEN 'extracted' ELSE 'inferred' END AS confidence, CASE WHEN suffix = '.py' THEN 'parser:ast' ELSE 'parser:regex' END AS provenance FROM cs WHERE suffix <> '.rb' AND NOT (suffix = '.py' AND doc_id % 17 = 4)),
chl AS (SELECT DISTINCT doc_id, line FROM ch WHERE side = 'after' UNION SELECT doc_id, 1000000 FROM files WHERE doc_id % 19 = 8 AND new_path IS NOT NULL),
en AS (SELECT c.doc_id, c.line, s.name, s.line AS start, s.end_line AS stop, c.line = s.line AS direct FROM chl c JOIN sy s ON c.doc_id = s.doc_id AND (c.line = s.line OR (c.line > s.line AND c.line <= s.end_line))),
gf AS (SELECT f.doc_id, f.path, coalesce(n_lines, 0) AS n_lines, {_end.replace('path', 'f.path')} AS suffix FROM files f LEFT JOIN cf USING (doc_id) WHERE new_path IS NOT NULL),
gs0 AS (SELECT g.*, CASE WHEN NOT EXISTS (SELECT 1 FROM chl c WHERE c.doc_id = g.doc_id) THEN 'no-changed-lines' WHEN suffix NOT IN {_suffixes(SUPPORTED)} THEN 'unsupported-language' WHEN suffix = '.py' AND n_lines > 0 AND doc_id % 17 = 4 THEN 'parse-unavailable' END AS state FROM gf g),
vl AS (SELECT c.doc_id, c.line, path FROM chl c JOIN gs0 g USING (doc_id) WHERE state IS NULL AND line <= n_lines),
se AS (SELECT e.doc_id, v.path, e.line, e.name, e.start, e.direct FROM en e JOIN vl v USING (doc_id, line)),
pe AS (SELECT s.doc_id, s.path, s.name, s.start AS line, bool_or(direct) AS direct, any_value(y.confidence) AS sure, any_value(y.provenance) AS provenance FROM se s JOIN sy y ON y.doc_id = s.doc_id AND y.name = s.name AND y.line = s.start GROUP BY ALL),
ff0 AS (SELECT CASE WHEN state = 'unsupported-language' THEN 'unsupported' ELSE 'changed_file' END AS kind, path, NULL::BIGINT AS line, NULL::VARCHAR AS symbol, CASE WHEN state = 'no-changed-lines' THEN 'unresolved' ELSE 'unavailable' END AS confidence, 'graph:' || state AS provenance FROM gs0 WHERE state IS NOT NULL
  UNION ALL SELECT 'definition', path, line, name, sure, provenance FROM pe UNION ALL SELECT CASE WHEN direct THEN 'changed_symbol' ELSE 'enclosing_symbol' END, path, line, name, CASE WHEN direct THEN sure ELSE 'inferred' END, provenance FROM pe
  UNION ALL SELECT 'changed_file', path, line, NULL, 'unresolved', 'graph:no-verified-containment' FROM vl v WHERE NOT EXISTS (SELECT 1 FROM se s WHERE s.doc_id = v.doc_id AND s.line = v.line)
  UNION ALL SELECT DISTINCT 'changed_file', path, NULL::BIGINT, NULL, 'unresolved', 'graph:invalid-changed-line' FROM chl JOIN gs0 USING (doc_id) WHERE state IS NULL AND line > n_lines),
ff1 AS (SELECT DISTINCT kind, 'after' AS side, path, line, symbol, NULL::VARCHAR AS target, confidence, provenance FROM ff0),
ff AS (SELECT {_fact} AS fact_id, * FROM ff1)"""
_impact = f"""
nm AS (SELECT DISTINCT symbol FROM ff WHERE kind IN ('changed_symbol', 'enclosing_symbol') UNION SELECT 'f_none'),
df AS (SELECT name AS symbol, s.path, s.line, g.n_lines, g.doc_id % 11 <> 6 AND g.n_lines > 0 AS there FROM sy s JOIN gf g USING (doc_id) WHERE name IN (SELECT symbol FROM nm)),
mn AS (SELECT symbol, count(*) > 1 AS many FROM df GROUP BY symbol),
ca AS (SELECT DISTINCT caller, callee, path FROM cs WHERE suffix <> '.rb' AND doc_id % 17 <> 4),
ed AS (SELECT 'caller' AS kind, callee AS symbol, caller AS target, path, 'inferred' AS confidence FROM ca UNION SELECT 'callee', caller, callee, path, 'inferred' FROM ca UNION SELECT 'static_test', callee, caller, path, 'inferred' FROM ca WHERE list_has_any(string_split(path, '/'), ['test', 'tests']) OR starts_with(string_split(path, '/')[-1], 'test_') UNION SELECT 'importer', callee, NULL, path, 'unresolved' FROM ca),
im0 AS (SELECT 'symbol' AS kind, '' AS path, NULL::BIGINT AS line, symbol, NULL::VARCHAR AS target, 'unresolved' AS confidence, 'graph' AS provenance FROM nm WHERE symbol NOT IN (SELECT symbol FROM df)
  UNION ALL SELECT 'definition', '', NULL, symbol, NULL, 'unresolved', 'graph:invalid-reference' FROM df WHERE NOT there
  UNION ALL SELECT 'definition', path, line, symbol, NULL, CASE WHEN many THEN 'ambiguous' ELSE 'unresolved' END, 'graph:unknown-parser' FROM df JOIN mn USING (symbol) WHERE there AND NOT EXISTS (SELECT 1 FROM ff WHERE ff.kind = 'definition' AND ff.symbol = df.symbol AND ff.path = df.path AND ff.line = df.line)
  UNION ALL SELECT e.kind, CASE WHEN g.doc_id % 11 <> 6 THEN e.path ELSE '' END, NULL, e.symbol, e.target, CASE WHEN g.doc_id % 11 <> 6 THEN e.confidence ELSE 'unresolved' END, CASE WHEN g.doc_id % 11 <> 6 THEN 'graph:unknown-parser' ELSE 'graph:invalid-reference' END FROM ed e JOIN gf g ON g.path = e.path WHERE e.symbol IN (SELECT symbol FROM df)),
im1 AS (SELECT DISTINCT kind, 'after' AS side, path, line, symbol, target, confidence, provenance FROM im0),
im AS (SELECT {_fact} AS fact_id, * FROM im1)"""
_enriched = f"""{_impact},
bo_ AS (SELECT * FROM ff UNION SELECT * FROM im),
ba AS (SELECT DISTINCT 'changed_file' AS kind, 'after' AS side, path, NULL::BIGINT AS line, NULL::VARCHAR AS symbol, NULL::VARCHAR AS target, 'unresolved' AS confidence, 'graph:no-resolved-symbol' AS provenance FROM files WHERE new_path IS NOT NULL AND path NOT IN (SELECT path FROM bo_)),
ri AS (SELECT * FROM bo_ UNION ALL SELECT {_fact} AS fact_id, * FROM ba)"""
_received_sql = f"""
re0 AS (SELECT *, path AS result, row_number() OVER (PARTITION BY path ORDER BY coalesce(line, 0), kind, coalesce(symbol, ''), coalesce(target, ''), fact_id) AS n FROM ff),
re1 AS (SELECT {FACT}, fact_id, result, n, CASE WHEN n % 7 = 0 THEN n * 10 + 15 ELSE n * 10 END AS pos FROM re0),
re AS (SELECT kind, side, path, line, CASE WHEN n % 31 = 0 THEN 'forged' ELSE symbol END AS symbol, target, confidence, provenance, fact_id, result, pos FROM re1 UNION ALL SELECT {FACT}, fact_id, result, pos + 1 FROM re1 WHERE n % 29 = 0)"""
#: The relations of GRAPH for the before side, whose texts are made of the before lines.
_relations = "co|cs|cf|sy|chl|en|gf|gs0|vl|se|pe|ff0|ff1|ff"
BEFORE = re.sub(rf"\b({_relations})\b", r"\1_b", GRAPH).replace("FROM lines l JOIN files f ON f.doc_id = l.doc_id AND f.new_path IS NOT NULL", "FROM (SELECT s.doc_id, o.old_path AS path, s.line AS line_no FROM snap s JOIN files o ON o.doc_id = s.doc_id AND o.old_path IS NOT NULL WHERE s.side = 'before') l")
BEFORE = BEFORE.replace("side = 'after'", "side = 'before'").replace("'after' AS side", "'before' AS side").replace("new_path IS NOT NULL", "old_path IS NOT NULL").replace("SELECT f.doc_id, f.path, coalesce(n_lines", "SELECT f.doc_id, f.old_path AS path, coalesce(n_lines").replace("(string_split(f.path,", "(string_split(f.old_path,")
_key = "(path, coalesce(line, 0), kind, coalesce(symbol, ''), coalesce(target, ''), fact_id)"
_edges = "edges AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS src, h AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages))"
_up_edges = "e AS (SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey >= 10 AND p_partkey % 5 = 0)"
_reach = "up(node, ancestor) AS (SELECT node, node FROM (SELECT node FROM e UNION SELECT parent FROM e) UNION SELECT up.node, e.parent FROM up JOIN e ON up.ancestor = e.node)"
_bad = lambda k, c, v: f"CASE WHEN pos % 6 = {k} THEN {v} ELSE {c} END AS {c}"
_pick = lambda by: f"CASE CAST(({by}) % 3 AS INTEGER) WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' ELSE 'disabled' END"

SQL = {
    "python_symbols": f"{BASE}, {GRAPH} SELECT doc_id, name, line, end_line, true AS parsed FROM sy WHERE path LIKE '%.py' UNION ALL SELECT doc_id, NULL, NULL, NULL, false FROM cf WHERE path LIKE '%.py' AND doc_id % 17 = 4",
    "brace_symbols": f"{BASE}, {GRAPH} SELECT doc_id, name, line, end_line FROM sy WHERE NOT path LIKE '%.py' AND end_line IS NOT NULL",
    "symbol_table": f"{BASE}, {GRAPH} SELECT doc_id, name, line, end_line, confidence, provenance FROM sy",
    "range_containment": f"{BASE}, {GRAPH} SELECT doc_id, line, name, start, stop FROM en WHERE stop IS NOT NULL",
    "innermost_symbol": f"{BASE}, {GRAPH} SELECT c.doc_id, c.line, name AS symbol, CASE WHEN name IS NULL THEN 'unresolved' WHEN direct THEN 'direct' ELSE 'enclosing' END AS how FROM chl c LEFT JOIN (SELECT * FROM en WHERE stop IS NOT NULL) e USING (doc_id, line)",
    "unresolved_lines": f"{BASE}, {GRAPH} SELECT doc_id, count(*) AS n_unresolved FROM chl c WHERE NOT EXISTS (SELECT 1 FROM en e WHERE e.doc_id = c.doc_id AND e.line = c.line AND stop IS NOT NULL) GROUP BY doc_id",
    "graph_file_facts": f"{BASE}, {GRAPH} SELECT fact_id, {FACT} FROM ff",
    "graph_both_sides": f"{BASE}, {GRAPH}, {BEFORE}, b AS (SELECT * FROM ff UNION ALL SELECT * FROM ff_b) SELECT fact_id, count(DISTINCT json_object('k', kind, 's', side, 'p', path, 'l', line, 'y', symbol, 't', target, 'c', confidence, 'v', provenance)) AS n_payloads, count(*) AS n_rows, min(kind) AS kind, min(path) AS path, min(symbol) AS symbol, min(target) AS target FROM b GROUP BY fact_id",
    "source_calls": f"{BASE}, {GRAPH} SELECT doc_id, path, caller, callee, 3 * line_no - 1 AS line FROM cs WHERE suffix <> '.rb' AND doc_id % 17 <> 4",
    "fact_place": f"{BASE}, {GRAPH} SELECT fact_id, row_number() OVER (ORDER BY CASE WHEN side = 'before' THEN 0 ELSE 1 END, path, coalesce(line, 0), kind, fact_id) AS n FROM ff",
    "graph_impact": f"{BASE}, {GRAPH}, {_impact} SELECT fact_id, {FACT} FROM im",
    "graph_enrich": f"{BASE}, {GRAPH}, {_enriched} SELECT kind, confidence, count(*) AS n_facts, count(DISTINCT fact_id) AS n_ids FROM ri GROUP BY ALL",
    "graph_incomplete": f"{BASE}, {GRAPH}, {_enriched} SELECT kind, confidence, count(*) AS n FROM ri WHERE kind = 'unsupported' OR confidence IN ('unresolved', 'unavailable') GROUP BY ALL",
    "fact_order": f"{BASE}, {GRAPH} SELECT fact_id, 1 AS side_rank, path, row_number() OVER (PARTITION BY path ORDER BY coalesce(line, 0), kind, fact_id) AS n FROM ff",
    "fact_faults": f"{BASE}, {GRAPH}, {_received_sql}, rf AS (SELECT result, {_fact} <> fact_id AS forged, count(*) OVER (PARTITION BY result, fact_id) > 1 AS twice, lag({_key}) OVER (PARTITION BY result ORDER BY pos) > {_key} AS late FROM re) SELECT result, error, count(*) AS n FROM (SELECT result, 'out of order' AS error FROM rf WHERE late UNION ALL SELECT result, 'repeated id' FROM rf WHERE twice UNION ALL SELECT result, 'wrong id' FROM rf WHERE forged) GROUP BY ALL",
    "fact_fields": f"{BASE}, {GRAPH}, iv0 AS (SELECT *, path AS result, row_number() OVER (PARTITION BY path ORDER BY coalesce(line, 0), kind, coalesce(symbol, ''), fact_id) AS pos FROM ff) SELECT result, CAST(pos AS INTEGER) AS pos, CASE CAST(pos % 6 AS INTEGER) WHEN 0 THEN 'kind' WHEN 1 THEN 'side' WHEN 2 THEN 'path' WHEN 3 THEN 'line' WHEN 4 THEN 'confidence' ELSE 'provenance' END AS field FROM iv0",
    "fact_merge": f"{BASE}, {GRAPH}, b AS (SELECT * FROM ff WHERE coalesce(line, 0) % 2 = 0 UNION ALL SELECT fact_id, kind, side, path, line, symbol, CASE WHEN line % 13 = 0 THEN 'x' ELSE target END, confidence, provenance FROM ff WHERE coalesce(line, 0) % 3 = 0) SELECT fact_id, count(DISTINCT json_object('k', kind, 'p', path, 'l', line, 's', symbol, 't', target, 'c', confidence)) AS n_payloads, count(*) AS n_rows, min(kind) AS kind, min(path) AS path, min(symbol) AS symbol, min(target) AS target FROM b GROUP BY fact_id",
    "id_recompute": f"{BASE}, {GRAPH}, {_received_sql} SELECT {_fact} = fact_id AS same, count(*) AS n FROM re GROUP BY ALL",
    "graph_status_merge": f"{BASE}, r AS (SELECT doc_id AS id, {_pick('doc_id')} AS b, {_pick('doc_id // 3')} AS a, CASE WHEN doc_id % 5 = 0 THEN 'a' ELSE 'b' END AS bp, CASE WHEN doc_id % 7 = 0 THEN 'a' ELSE 'b' END AS ap, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'k' || doc_id END AS bk, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'k' || doc_id END AS ak, doc_id FROM files) SELECT id, CASE WHEN b = 'disabled' AND a = 'disabled' THEN 'disabled' WHEN b = 'available' AND a = 'available' THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN bp = ap THEN ap ELSE bp || '+' || ap END AS provider, CASE WHEN (doc_id % 4 = 0) = (doc_id % 6 = 0) AND doc_id % 6 <> 0 THEN '1' END AS version, CASE WHEN bk IS NULL AND ak IS NULL THEN NULL ELSE coalesce(bk, 'none') || ':' || coalesce(ak, 'none') END AS cache_key, concat_ws(',', CASE WHEN b = 'unavailable' AND doc_id % 2 = 0 THEN 'before' END, CASE WHEN a = 'unavailable' AND doc_id % 5 = 0 THEN 'after' END) AS missing FROM r",
    "graph_references": f"{BASE}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) SELECT doc_id AS id FROM files LEFT JOIN n USING (doc_id) WHERE doc_id % 4 IN (1, 3) OR n IS NULL OR (doc_id % 3 <> 0 AND (doc_id % 50 < 1 OR doc_id % 50 > n))",
    "graph_values": "WITH v AS (SELECT event_id, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'extracted' WHEN 1 THEN 'inferred' WHEN 2 THEN 'ambiguous' ELSE 'unresolved' END AS confidence FROM events) SELECT CAST(event_id AS BIGINT) AS event_id, confidence, CASE WHEN confidence = 'extracted' AND event_id % 2 = 0 THEN 'inferred' ELSE confidence END AS by_parser, CASE WHEN event_id % 4 = 0 AND event_id >= 1 THEN CAST(event_id AS BIGINT) END AS line FROM v",
    "graph_index": f"{BASE} SELECT sha256(CAST(to_json(['graph-index/v1', 'symbols/v1', path, sha256(text)]) AS VARCHAR)) AS key, doc_id % 9 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS usable FROM files",
    "blast_radius": f"WITH {_edges} SELECT DISTINCT symbol, kind, target FROM (SELECT dst AS symbol, 'caller' AS kind, src AS target FROM edges UNION ALL SELECT src, 'callee', dst FROM edges)",
    "dependency_closure": f"WITH RECURSIVE {_up_edges}, {_reach} SELECT node, count(*) AS n_reached, CAST(min(ancestor) AS BIGINT) AS lowest FROM up GROUP BY node",
    "merge_base": f"WITH RECURSIVE {_up_edges}, {_reach}, p AS (SELECT DISTINCT node AS left_node, node + 7 AS right_node FROM e), c AS (SELECT p.*, a.ancestor FROM p JOIN up a ON a.node = left_node JOIN up b ON b.node = right_node AND a.ancestor = b.ancestor), d AS (SELECT DISTINCT left_node, right_node, up.ancestor FROM c JOIN up ON up.node = c.ancestor AND up.node <> up.ancestor) SELECT left_node, right_node, count(*) AS n_bases, min(ancestor) AS base FROM c ANTI JOIN d USING (left_node, right_node, ancestor) GROUP BY ALL",
    "ledger_metrics": f"""{BUDGETED}{PATCH}, {GRAPH} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE status = 'added') AS added_files, (SELECT count(*) FROM files WHERE status = 'deleted') AS deleted_files, (SELECT count(*) FROM files WHERE status = 'renamed') AS renamed_files,
  (SELECT count(*) FROM units) AS units, (SELECT count(*) FROM units WHERE kind = 'binary') AS binary_units, (SELECT count(*) FROM units WHERE kind = 'unsupported') AS unsupported_units, (SELECT count(*) FROM hunks) AS hunks, (SELECT count(*) FROM spans) AS spans, (SELECT count(*) FROM ch WHERE side = 'after') AS added_lines, (SELECT count(*) FROM ch WHERE side = 'before') AS deleted_lines, (SELECT count(*) FROM ch) AS changed_lines,
  (SELECT count(*) FROM bud) AS source_citations, (SELECT count(*) FROM bud WHERE omitted) AS omitted_source_contexts, (SELECT count(*) FROM ff) AS graph_facts, (SELECT count(*) FROM ff WHERE confidence IN ('unresolved', 'unavailable') OR kind = 'unsupported') AS unresolved_graph_facts, (SELECT count(DISTINCT group_class) FROM gr0) AS classification_groups, (SELECT CAST(sum(strlen(patch)) AS BIGINT) FROM pt) AS raw_patch_bytes, 1.0::DOUBLE AS line_coverage_ratio, 1.0::DOUBLE AS hunk_coverage_ratio, 1.0::DOUBLE AS unit_coverage_ratio""",
    "evidence_appendix": f"""{BUDGETED}, {GRAPH}, fa AS (SELECT path, string_agg('- `' || fact_id || '` ' || kind || ' ' || coalesce(symbol, '') || ' at `' || CASE WHEN line IS NOT NULL THEN path || ':' || line WHEN path <> '' THEN path ELSE 'unresolved location' END || '` (' || confidence || '; ' || provenance || ')', chr(10) ORDER BY side, coalesce(line, 0), kind, fact_id) AS fact_text FROM ff GROUP BY path),
om AS (SELECT path, string_agg('- `' || citation_id || '` — retrieve `' || path || '` ' || side || ':' || start_line || '-' || end_line || ' (sha256 `' || content_hash || '`)', chr(10) ORDER BY side, start_line, citation_id) AS gone_text FROM bud WHERE omitted GROUP BY path)
SELECT path, concat_ws(chr(10), '#### Structural enrichment' || chr(10) || chr(10) || fact_text || chr(10), '#### Omitted source context' || chr(10) || chr(10) || gone_text || chr(10)) AS markdown FROM fa FULL JOIN om USING (path)""",
    "evidence_overview": f"""{BUDGETED}, {GRAPH}, ga AS (SELECT string_agg('- ' || group_class || ': ' || n || ' units (`' || {sid('group', 'group_class')} || '`)', chr(10) ORDER BY group_class) AS group_text FROM (SELECT group_class, count(*) AS n FROM gr0 GROUP BY group_class)),
dg AS (SELECT string_agg('- **' || code || '**: ' || message || ' (' || n || ' files)', chr(10) ORDER BY code, message) AS noted FROM (SELECT code, message, count(*) AS n FROM (SELECT DISTINCT doc_id, CASE WHEN outcome = 'exceeded' THEN {quote(C.EXCEEDED[0])} ELSE {quote(C.OMITTED[0])} END AS code, CASE WHEN outcome = 'exceeded' THEN {quote(C.EXCEEDED[1])} ELSE {quote(C.OMITTED[1])} END AS message FROM bud WHERE outcome <> 'fits') GROUP BY ALL))
SELECT concat_ws(chr(10), '# Evidence', '', 'Comparison: `documents`', '', '## Change ledger', '', (SELECT count(*) FROM files) || ' files · ' || (SELECT count(*) FROM units) || ' units · ' || (SELECT count(*) FROM hunks) || ' hunks · ' || (SELECT count(*) FROM spans) || ' spans · ' || (SELECT count(*) FROM ch WHERE side = 'after') || ' added lines · ' || (SELECT count(*) FROM ch WHERE side = 'before') || ' deleted lines', '', CASE WHEN (SELECT count(*) FROM files) = 0 THEN '**No changes are present in this comparison.**' || chr(10) END,
  '## Classes' || chr(10) || chr(10) || group_text || chr(10), '## Structural enrichment', '', 'Graph: **available**, ' || (SELECT count(*) FROM ff) || ' facts' || chr(10), '## Diagnostics' || chr(10) || chr(10) || noted || chr(10)) AS markdown FROM ga, dg""",
}
