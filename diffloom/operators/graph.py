"""Symbols around changed lines, one-hop neighbourhoods, fact merging and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import normal_path, stable_id, suffix_of
from ..functions.symbols import SUPPORTED, code_uses
from ..sources.tables import written
from .order import placed
from .validate import CONFIDENCE

#: Lines of a bucket in which ranges meet lines.
BUCKET = 64
FACT = ("kind", "side", "path", "line", "symbol", "target", "confidence", "provenance")
FACT_SCHEMA = "kind string, side string, path string, line long, symbol string, target string, confidence string, provenance string, fact_id string"
#: Kinds of facts, and modes of enrichment.
FACT_KINDS = ["definition", "changed_symbol", "enclosing_symbol", "changed_file", "unsupported", "symbol", "caller", "callee", "static_test", "importer"]
MODES = ("auto", "off", "required")


def confidence(value: Column) -> Column:
    """One of the epistemic categories; anything else is unresolved."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(CONFIDENCE), plain).otherwise("unresolved")


def line_number(value: Column) -> Column:
    """An integer of 1 or more, else null."""
    n = value.try_cast("long")
    return F.when(n >= 1, n)


def parser_confidence(value: Column, parser: Column) -> Column:
    """What a pattern finds is inferred at most."""
    return F.when((parser == "regex") & (value == "extracted"), "inferred").otherwise(value)


def enclosing(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Changed lines joined with the symbols whose range holds them: start < line <= end, or exactly on a declaration.

    Ranges are cut at multiples of BUCKET, so that a line meets the ranges
    around it and not all of its file.
    """
    s = symbols.selectExpr("doc_id", "name", "line AS start", "end_line AS stop", f"explode(sequence(line div {BUCKET}, coalesce(end_line, line) div {BUCKET})) AS bucket")
    return changed.withColumn("bucket", F.expr(f"line div {BUCKET}")).join(s.hint("merge"), ["doc_id", "bucket"]).where("line = start OR (line > start AND line <= stop)").drop("bucket")


def selected(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, line, name, start, direct: for each changed line all symbols declared on it, else the innermost range around it if no other one has the same ends."""
    hit = enclosing(changed, symbols).selectExpr("*", "line = start AS direct")
    order = "OVER (PARTITION BY doc_id, line ORDER BY IF(direct, 0, 1), IF(direct, 0, -start), IF(direct, 0, stop))"
    best = hit.selectExpr("*", f"rank() {order} AS r").where("r = 1").selectExpr("*", "count(1) OVER (PARTITION BY doc_id, line) AS n")
    return best.where("direct OR n = 1").select("doc_id", "line", "name", "start", "direct")


def innermost(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each changed line with symbol and how: direct, enclosing, or unresolved; of several direct ones the first by name."""
    one = selected(changed, symbols).groupBy("doc_id", "line").agg(F.min("name").alias("symbol"), F.max("direct").alias("direct"))
    return changed.join(one, ["doc_id", "line"], "left").selectExpr("doc_id", "line", "symbol", "CASE WHEN symbol IS NULL THEN 'unresolved' WHEN direct THEN 'direct' ELSE 'enclosing' END AS how")


def facts(rows: DataFrame) -> DataFrame:
    """Rows of FACT with fact_id, each once."""
    return rows.select(*FACT).distinct().withColumn("fact_id", stable_id("fact", *FACT))


def file_facts(files: DataFrame, changed: DataFrame, symbols: DataFrame, unparsed: DataFrame, side: str) -> DataFrame:
    """Facts of changed files (doc_id, path, n_lines) from their changed lines (doc_id, line) and symbols.

    A file without changed lines, of an unsupported language or that doesn't
    parse has one fact that says so. Others have a definition and a changed or
    enclosing symbol for each symbol selected, an unresolved row for each line
    without one, and one if a changed line lies beyond the file's end.
    """
    has = files.join(changed.groupBy("doc_id").agg(F.max("line").alias("last")).hint("merge"), "doc_id", "left").join(unparsed.withColumn("broken", F.lit(True)).hint("merge"), "doc_id", "left")
    state = F.when(F.col("last").isNull(), "no-changed-lines").when(~F.coalesce(suffix_of("path").isin(SUPPORTED), F.lit(False)), "unsupported-language").when(F.col("broken"), "parse-unavailable")
    told = has.withColumn("state", state)
    null = F.lit(None).cast("string")
    row = lambda df, kind, line, symbol, sure, provenance: df.select(kind.alias("kind"), F.lit(side).alias("side"), "path", line.cast("long").alias("line"), symbol.alias("symbol"), null.alias("target"), sure.alias("confidence"), provenance.alias("provenance"))
    plain = told.where("state IS NOT NULL")
    first = row(plain, F.when(F.col("state") == "unsupported-language", "unsupported").otherwise("changed_file"), F.lit(None), null, F.when(F.col("state") == "no-changed-lines", "unresolved").otherwise("unavailable"), F.concat(F.lit("graph:"), "state"))
    read = told.where("state IS NULL").select("doc_id", "path", "n_lines")
    lines = changed.join(read.hint("merge"), "doc_id")
    valid = lines.where("line BETWEEN 1 AND n_lines").select("doc_id", "line").distinct()
    chosen = selected(valid, symbols)
    per = chosen.groupBy("doc_id", "name", F.col("start").alias("line")).agg(F.max("direct").alias("direct")).join(symbols.select("doc_id", "name", "line", F.col("confidence").alias("sure"), "provenance").hint("merge"), ["doc_id", "name", "line"]).join(read.select("doc_id", "path").hint("merge"), "doc_id")
    two = F.explode(F.array(F.struct(F.lit("definition").alias("k"), F.col("sure").alias("c")), F.struct(F.when(F.col("direct"), "changed_symbol").otherwise("enclosing_symbol").alias("k"), F.when(F.col("direct"), F.col("sure")).otherwise("inferred").alias("c"))))
    second = row(per.withColumn("x", two), F.col("x.k"), F.col("line"), F.col("name"), F.col("x.c"), F.col("provenance"))
    lost = valid.join(chosen.select("doc_id", "line").distinct().hint("merge"), ["doc_id", "line"], "left_anti").join(read.select("doc_id", "path").hint("merge"), "doc_id")
    third = row(lost, F.lit("changed_file"), F.col("line"), null, F.lit("unresolved"), F.lit("graph:no-verified-containment"))
    beyond = lines.where("line < 1 OR line > n_lines").select("doc_id", "path").distinct()
    fourth = row(beyond, F.lit("changed_file"), F.lit(None), null, F.lit("unresolved"), F.lit("graph:invalid-changed-line"))
    return facts(first.unionByName(second).unionByName(third).unionByName(fourth))


def impact_facts(names: DataFrame, definitions: DataFrame, parsed: DataFrame, edges: DataFrame, snapshot: DataFrame, side: str) -> DataFrame:
    """One hop from selected names (symbol), by bare name.

    definitions (name, path, line) that aren't parsed (name, path, line) already
    are given, as ambiguous if the name has several. edges (kind: caller,
    callee, static_test, importer; symbol, target, path, confidence) follow. A
    name without definition is an unresolved symbol. What refers to a path or
    line that the snapshot (path, n_lines) doesn't have loses its path.
    """
    null, known = F.lit(None).cast("string"), snapshot.select("path", "n_lines")
    chosen = names.select("symbol").distinct()
    row = lambda df, kind, path, line, target, sure, provenance: df.select(kind.alias("kind"), F.lit(side).alias("side"), path.alias("path"), line.cast("long").alias("line"), "symbol", target.alias("target"), sure.alias("confidence"), provenance.alias("provenance"))
    own = definitions.withColumnRenamed("name", "symbol").join(chosen, "symbol", "left_semi")
    lost = chosen.join(own.select("symbol"), "symbol", "left_anti")
    first = row(lost, F.lit("symbol"), F.lit(""), F.lit(None), null, F.lit("unresolved"), F.lit("graph"))
    many = own.groupBy("symbol").agg((F.count("*") > 1).alias("many"))
    placed = own.withColumn("path", normal_path("path")).join(known, "path", "left").withColumn("valid", F.coalesce(F.col("line").between(F.lit(1), F.col("n_lines")), F.lit(False)))
    second = row(placed.where("NOT valid"), F.lit("definition"), F.lit(""), F.lit(None), null, F.lit("unresolved"), F.lit("graph:invalid-reference"))
    new = placed.where("valid").join(parsed.select(F.col("name").alias("symbol"), "path", "line"), ["symbol", "path", "line"], "left_anti").join(many, "symbol")
    third = row(new, F.lit("definition"), F.col("path"), F.col("line"), null, F.when(F.col("many"), "ambiguous").otherwise("unresolved"), F.lit("graph:unknown-parser"))
    # each edge once for every definition of its name; ids make equal ones one fact
    near = edges.join(own.select("symbol").distinct(), "symbol", "left_semi").withColumn("path", normal_path("path")).join(known, "path", "left").withColumn("valid", F.col("n_lines").isNotNull())
    sure = F.when(F.col("kind") == "importer", "unresolved").otherwise(confidence(F.col("confidence")))
    fourth = row(near, F.col("kind"), F.when(F.col("valid"), F.col("path")).otherwise(""), F.lit(None), F.when(F.col("kind") != "importer", F.col("target")), F.when(F.col("valid"), sure).otherwise("unresolved"), F.when(F.col("valid"), F.lit("graph:unknown-parser")).otherwise("graph:invalid-reference"))
    return facts(first.unionByName(second).unionByName(third).unionByName(fourth))


def call_edges(calls: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Edges of calls (caller, callee, path): callers, callees, tests (calls from test files) and importers.

    Importers are the paths of imports (name, path); without those, paths that call a name.
    """
    name = F.element_at(F.split("path", "/"), -1)
    test = F.arrays_overlap(F.split("path", "/"), F.array(F.lit("test"), F.lit("tests"))) | name.startswith("test_")
    edge = lambda df, kind, symbol, target: df.select(F.lit(kind).alias("kind"), symbol.alias("symbol"), target.alias("target"), "path", F.lit("inferred").alias("confidence"))
    rows = edge(calls, "caller", F.col("callee"), F.col("caller")).unionByName(edge(calls, "callee", F.col("caller"), F.col("callee"))).unionByName(edge(calls.where(test), "static_test", F.col("callee"), F.col("caller")))
    own = edge(calls, "importer", F.col("callee"), F.lit(None).cast("string")) if imports is None else edge(imports, "importer", F.col("name"), F.lit(None).cast("string"))
    return rows.unionByName(own).distinct()


def text_edges(files: DataFrame) -> DataFrame:
    """The edges that the texts of files (doc_id, path, text) have: calls within a symbol, and imports."""
    uses = written(files.sparkSession, code_uses(files).join(files.select("doc_id", "path"), "doc_id"), "uses")
    calls = uses.where("kind = 'call' AND caller IS NOT NULL").select("caller", F.col("name").alias("callee"), "path").distinct()
    return call_edges(calls, uses.where("kind = 'import'").select("name", "path").distinct())


def enrich(found: DataFrame, impact: DataFrame, files: DataFrame, side: str) -> DataFrame:
    """Facts of both kinds, each id once; a changed file is unresolved if there is no fact at all for its path."""
    both = found.unionByName(impact)
    bare = files.join(both.where("path <> ''").select("path").distinct(), "path", "left_anti")
    none = facts(bare.select(F.lit("changed_file").alias("kind"), F.lit(side).alias("side"), "path", F.lit(None).cast("long").alias("line"), *[F.lit(None).cast("string").alias(c) for c in ("symbol", "target")], F.lit("unresolved").alias("confidence"), F.lit("graph:no-resolved-symbol").alias("provenance")))
    return both.unionByName(none).dropDuplicates(["fact_id"])


def incomplete(facts_: DataFrame) -> DataFrame:
    """Facts that a required enrichment must not have."""
    return facts_.where("kind = 'unsupported' OR confidence IN ('unresolved', 'unavailable')")


def enriched(facts_: DataFrame, mode: str = "auto") -> tuple[str, DataFrame]:
    """(status, facts) by mode: off gives none; required raises ValueError if a fact is unsupported, unresolved or unavailable."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "off":
        return "disabled", facts_.where("false")
    if mode == "required" and (bad := incomplete(facts_).select("kind", "path", "symbol").first()):
        raise ValueError(f"required enrichment is incomplete: {bad.kind} fact for {bad.path or bad.symbol or 'unknown'}")
    return "available", facts_


def in_whole_order(facts_: DataFrame) -> DataFrame:
    """Facts of a merged graph with n, their place among all: by side (before first), path, line, kind and id."""
    return placed(facts_, [F.when(F.col("side") == "before", 0).otherwise(1), F.col("path"), F.coalesce("line", F.lit(0)), F.col("kind"), F.col("fact_id")], place="n")


def in_order(facts_: DataFrame, merged: bool = True) -> DataFrame:
    """Facts with n, their place: by side (before first), path, line, kind and id in a merged graph; by path, line, kind, symbol, target and id in one side's result.

    The place is counted within each path, paths being in order themselves, so that no task sorts everything.
    """
    rest = "coalesce(line, 0), kind, fact_id" if merged else "coalesce(line, 0), kind, coalesce(symbol, ''), coalesce(target, ''), fact_id"
    return facts_.selectExpr("*", "IF(side = 'before', 0, 1) AS side_rank", f"row_number() OVER (PARTITION BY side, path ORDER BY {rest}) AS n")


def order_faults(received: DataFrame) -> DataFrame:
    """Received facts (pos and FACT, fact_id) that stand before a smaller one, repeat an id, or whose id isn't the hash of their fields."""
    order = "struct(path, coalesce(line, 0) AS line, kind, coalesce(symbol, '') AS symbol, coalesce(target, '') AS target, fact_id)"
    per = "PARTITION BY result ORDER BY pos"
    rows = received.selectExpr("*", f"lag({order}) OVER ({per}) > {order} AS late", "count(1) OVER (PARTITION BY result, fact_id) > 1 AS twice").withColumn("forged", F.col("fact_id") != stable_id("fact", *FACT))
    error = F.filter(F.array(F.when(F.col("late"), F.lit("out of order")), F.when(F.col("twice"), F.lit("repeated id")), F.when(F.col("forged"), F.lit("wrong id"))), lambda x: x.isNotNull())
    return rows.select("result", "pos", F.explode(error).alias("error"))


def invalid_facts(received: DataFrame) -> DataFrame:
    """result, pos, field of received facts with values that no fact may have."""
    bad = {
        "kind": ~F.coalesce(F.col("kind").isin(FACT_KINDS), F.lit(False)), "side": ~F.coalesce(F.col("side").isin("before", "after"), F.lit(False)),
        "path": F.col("path").isNull() | ((F.col("path") != "") & ~F.col("path").eqNullSafe(normal_path("path"))), "line": F.coalesce(F.col("line") < 1, F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").isin(CONFIDENCE), F.lit(False)), "provenance": F.coalesce("provenance", F.lit("")) == "",
    }
    fields = F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in bad.items()]), lambda x: x.isNotNull())
    return received.select("result", "pos", F.explode(fields).alias("field"))


def merged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts of both sides by id; n_payloads over 1 is a conflict."""
    both = before.unionByName(after)
    payload = F.to_json(F.struct(*FACT), {"ignoreNullFields": "false"})
    return both.groupBy("fact_id").agg(F.count_distinct(payload).alias("n_payloads"), F.count("*").alias("n_rows"), *[F.min(c).alias(c) for c in ("kind", "path", "symbol", "target")])


def merged_status(before: Column, after: Column) -> Column:
    same = lambda v: (before == v) & (after == v)
    return F.when(same("disabled"), "disabled").when(same("available"), "available").otherwise("unavailable")


def merged_results(rows: DataFrame) -> DataFrame:
    """rows (id, and status, provider, version, cache_key of both sides as before_ and after_) with the merged ones and missing, sides that are unavailable without a diagnostic (before_diagnostics, after_diagnostics)."""
    b, a = (lambda c: F.col(f"before_{c}")), (lambda c: F.col(f"after_{c}"))
    key = F.when(b("cache_key").isNotNull() | a("cache_key").isNotNull(), F.concat_ws(":", F.coalesce(b("cache_key"), F.lit("none")), F.coalesce(a("cache_key"), F.lit("none"))))
    silent = F.array_join(F.filter(F.array(*[F.when((F.col(f"{s}_status") == "unavailable") & (F.col(f"{s}_diagnostics") == 0), F.lit(s)) for s in ("before", "after")]), lambda x: x.isNotNull()), ",")
    return rows.select("id", merged_status(b("status"), a("status")).alias("status"), F.when(b("provider") == a("provider"), a("provider")).otherwise(F.concat_ws("+", b("provider"), a("provider"))).alias("provider"), F.when(b("version").eqNullSafe(a("version")), a("version")).alias("version"), key.alias("cache_key"), silent.alias("missing"))


def neighbours(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop from chosen symbols (symbol) over edges (src, dst): callers and callees."""
    callers = edges.join(chosen.select(F.col("symbol").alias("dst")).distinct(), "dst").select(F.col("dst").alias("symbol"), F.lit("caller").alias("kind"), F.col("src").alias("target"))
    callees = edges.join(chosen.select(F.col("symbol").alias("src")).distinct(), "src").select(F.col("src").alias("symbol"), F.lit("callee").alias("kind"), F.col("dst").alias("target"))
    return callers.unionByName(callees).distinct()


def ancestors(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Reachability over (node, parent): node, ancestor, itself included, each pair once.

    Pairs have their distance. If all of up to L steps are known, one of L + 1 to
    2 L is one of exactly L and a known one behind it, so lengths double in each
    round, and a pair is made once for each node that lies L steps away and
    between, not for each between. A chain of n links takes log2(n) rounds, and
    there is no limit to its length. Cycles are allowed. Only new pairs are written.
    """
    ends = edges.select(F.explode(F.array("node", "parent")).alias("node")).distinct().select("node", F.col("node").alias("ancestor"))
    reach = written(spark, edges.where("node <> parent").select("node", F.col("parent").alias("ancestor")).distinct().withColumn("steps", F.lit(1)), "reach")
    length = 1
    while not (far := reach.where(f"steps = {length}")).isEmpty():
        # dealt by node alone: once, for what lies behind and for what is known already
        by_node = reach.repartition("node")
        behind = by_node.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("steps").alias("more"))
        made = far.select("node", "ancestor").join(behind, "ancestor").where("node <> further").select("node", F.col("further").alias("ancestor"), (F.col("more") + length).alias("steps"))
        nearest = by_node.unionByName(made.repartition("node")).groupBy("node", "ancestor").agg(F.min("steps").alias("steps"))
        reach = reach.unionByName(written(spark, nearest.where(f"steps > {length}"), "reach"))
        length *= 2
    return reach.select("node", "ancestor").unionByName(ends)


def _followed(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (node, to), one for each node, followed as long as to has a link itself: lengths double in each round, and rows stay as many as there are links. Rings lead nowhere and go."""
    links = written(spark, links, "links")
    open_ = links.alias("a").join(links.alias("b"), F.col("a.to") == F.col("b.node"), "left")
    rounds = links.count().bit_length() + 1
    for _ in range(rounds):
        links = written(spark, open_.select(F.col("a.node").alias("node"), F.coalesce("b.to", "a.to").alias("to"), F.col("b.to").isNotNull().alias("more")), "links")
        if links.where("more").isEmpty():
            break
        links = links.drop("more")
        open_ = links.alias("a").join(links.alias("b"), F.col("a.to") == F.col("b.node"), "left")
    there = links.select(F.col("node").alias("to"))
    return links.select("node", "to").join(there, "to", "left_anti").select("node", "to")


def contracted(spark: SparkSession, edges: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, inner) of a graph (node, parent) around asked nodes (node).

    Nodes that have one parent and one child, and aren't asked for, only lie on
    the way: edges (node, parent) run between the others, and inner (node, head)
    gives of each such node the first other node from which one comes to it.
    """
    links = written(spark, edges.where("node <> parent").select("node", "parent").distinct(), "edges")
    one = links.groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("up")).where("n = 1").select("node", "up")
    child = links.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.first("node").alias("down")).where("n = 1").select("node", "down")
    way = written(spark, one.join(child, "node").join(asked.select("node"), "node", "left_anti"), "way")
    ups, downs = _followed(spark, way.select("node", F.col("up").alias("to"))), _followed(spark, way.select("node", F.col("down").alias("to")))
    outer = links.join(way.select("node"), "node", "left_anti")
    short = outer.join(ups.select(F.col("node").alias("parent"), F.col("to").alias("end")), "parent", "left").select("node", F.coalesce("end", "parent").alias("parent")).where("node <> parent").distinct()
    return written(spark, short, "edges"), downs.select("node", F.col("to").alias("head"))


#: Steps of a search that one job takes.
STEPS = 4


def reached(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: what each of starts (start) comes to over edges (node, parent), itself included; each pair once.

    Only the frontier goes on in each round, so rows are as many as nodes
    are visited; a round takes STEPS steps. Cycles are allowed. Rounds are
    as many as the longest way has steps, divided by that: contract the graph first.
    """
    return _search(spark, edges, starts.select("start", F.col("start").alias("node")).distinct())


def _search(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (node and others), and the same with every node that theirs comes to, each row once."""
    step = lambda at: at.join(edges, "node").drop("node").withColumnRenamed("parent", "node").select(starts.columns).distinct()
    seen = front = written(spark, starts, "front")
    while True:
        at, new = front, None
        for _ in range(STEPS):
            at = step(at)
            new = at if new is None else new.unionByName(at)
        front = written(spark, new.distinct().join(seen, starts.columns, "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def depths(spark: SparkSession, edges: DataFrame) -> DataFrame | None:
    """node, depth of every node of edges (node, parent), each once: the steps of its longest way to a node without parents. None if some node comes to a ring.

    A node is done in the round after the last of its parents, so each edge is
    met once and rounds are as many as the longest way has steps.
    """
    links = written(spark, edges.join(edges.groupBy("node").agg(F.count("*").alias("parents")), "node"), "links")
    front = written(spark, links.select(F.col("parent").alias("node")).distinct().join(links.select("node"), "node", "left_anti").withColumn("depth", F.lit(0)), "front")
    found, waiting, step = front, None, 0
    while not front.isEmpty():
        step += 1
        told = links.join(front.select(F.col("node").alias("parent")), "parent").select("node", "parents", F.lit(1).cast("long").alias("done"))
        told = told if waiting is None else told.unionByName(waiting)
        told = written(spark, told.groupBy("node").agg(F.first("parents").alias("parents"), F.sum("done").alias("done")), "told")
        front, waiting = told.where("done = parents").select("node", F.lit(step).alias("depth")), told.where("done < parents")
        found = found.unionByName(front)
        if step % JOINED == 0:
            found = written(spark, found, "depths")
    found = written(spark, found, "depths")
    nodes = links.select(F.explode(F.array("node", "parent")).alias("node")).distinct()
    return found if found.count() == nodes.count() else None


#: Tables of a search that are read one by one before they are written as one.
JOINED = 32
#: Who comes to a node: the left one, the right one, both; then whether a common ancestor comes to it as well.
LEFT, RIGHT, BOTH, BELOW = 1, 2, 3, 4


def merge_bases(spark: SparkSession, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (left_node, right_node): common ancestors over (node, parent) that no other common ancestor descends from, and their number; only a number of 1 is a merge base.

    A node is its own ancestor. Such an ancestor is asked for itself or has
    several children, so the search runs over the contracted graph. Each pair
    goes down from its own ends, deepest nodes first (see depths), so that a node's
    turn comes when all that descends to it is known. It ends where nothing
    new can be common: rows are as many as nodes lie above and beside a pair's
    bases, however much lies below. If there are rings, all ancestors are searched.
    """
    pairs = pairs.select("left_node", "right_node").where("left_node IS NOT NULL AND right_node IS NOT NULL").distinct()
    asked = pairs.select(F.explode(F.array("left_node", "right_node")).alias("node")).distinct()
    short, _ = contracted(spark, edges, asked)
    deep = depths(spark, short)
    best = _nearest(spark, short, deep, pairs) if deep is not None else _uncovered(spark, short, pairs, asked)
    return best.groupBy("left_node", "right_node").agg(F.count("*").alias("n_bases"), F.min("node").alias("base"))


def _uncovered(spark: SparkSession, edges: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """left_node, right_node, node: the common ancestors without those that have a common child, as an ancestor of a common one is common as well."""
    seen = reached(spark, edges, asked.select(F.col("node").alias("start")))
    of = lambda end: seen.select(F.col("start").alias(end), "node")
    both = written(spark, pairs.join(of("left_node"), "left_node").join(of("right_node"), ["right_node", "node"]).select("left_node", "right_node", "node"), "common")
    lower = both.join(edges, "node").select("left_node", "right_node", F.col("parent").alias("node")).distinct()
    return both.join(lower, ["left_node", "right_node", "node"], "left_anti")


def _nearest(spark: SparkSession, edges: DataFrame, deep: DataFrame, pairs: DataFrame) -> DataFrame:
    """left_node, right_node, node: the common ancestors that no other one comes to, in a graph (node, parent) without rings whose nodes have a depth.

    A row of a pair is a node that it has come to, with who comes to it (told).
    Those of the pair's greatest depth go on to their parents. A node that both
    come to, and nothing common does, is one of the answer; what lies behind it is BELOW.
    A pair goes on while a node that both come to waits for its turn, or both
    have nodes of their own, which may still meet.
    """
    links = written(spark, edges.join(deep.withColumnsRenamed({"node": "parent"}), "parent").select("node", "parent", F.col("depth").alias("further")), "links")
    at = ["left_node", "right_node"]
    ends = pairs.select(*at, F.explode(F.array(F.struct(F.col("left_node").alias("node"), F.lit(LEFT).alias("told")), F.struct(F.col("right_node").alias("node"), F.lit(RIGHT).alias("told")))).alias("x")).select(*at, "x.*")
    rows = ends.join(deep, "node", "left").select(*at, "node", F.coalesce("depth", F.lit(0)).alias("depth"), "told")
    per = Window.partitionBy(*at)
    found, step = None, 0
    while True:
        # dealt by pair alone, which serves the grouping by node as well
        met = rows.repartition(*at).groupBy(*at, "node").agg(F.first("depth").alias("depth"), F.bit_or("told").alias("told"))
        met = met.withColumn("top", F.col("depth") == F.max("depth").over(per))
        base = F.col("top") & (F.col("told") == BOTH)
        apart = F.max(F.col("told") == LEFT).over(per) & F.max(F.col("told") == RIGHT).over(per)
        later = F.max(~F.col("top") & (F.col("told") == BOTH)).over(per)
        met = met.select("*", base.alias("base"), (apart | later).alias("more"))
        state = written(spark, met.where("base OR more"), "state")
        answer, more = state.where("base").select(*at, "node"), state.where("more")
        found, step = answer if found is None else found.unionByName(answer), step + 1
        if more.isEmpty():
            return found
        if step % JOINED == 0:
            found = written(spark, found, "bases")
        told = F.when(F.col("told") == BOTH, BOTH | BELOW).otherwise(F.col("told"))
        up = more.where("top").join(links, "node").select(*at, F.col("parent").alias("node"), F.col("further").alias("depth"), told.alias("told"))
        rows = more.where("NOT top").select(*at, "node", "depth", "told").unionByName(up)


def descended(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: everything that some start (node) comes to over (node, parent), itself included."""
    short, inner = contracted(spark, edges, starts)
    found = _search(spark, short, starts.select("node").distinct())
    return found.unionByName(inner.join(found.withColumnRenamed("node", "head"), "head").select("node"))


def request_errors(requests: DataFrame) -> DataFrame:
    """id, error of requests (id, side, paths, lines: map of path to line numbers): sides and paths are as facts have them, paths and lines sorted and once each, lines of known paths."""
    ordered = lambda a: a == F.array_sort(F.array_distinct(a))
    keys = F.map_keys("lines")
    rules = [
        ("unknown side", ~F.coalesce(F.col("side").isin("before", "after"), F.lit(False))),
        ("paths not sorted or repeated", ~ordered(F.col("paths"))),
        ("unsafe path", F.exists("paths", lambda p: ~p.eqNullSafe(normal_path(p)))),
        ("lines not sorted or repeated", F.exists(F.map_values("lines"), lambda v: ~ordered(v))),
        ("line below 1", F.exists(F.map_values("lines"), lambda v: F.exists(v, lambda x: x < 1))),
        ("lines of no path", F.size(F.array_except(keys, F.col("paths"))) > 0),
    ]
    errors = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for text, cond in rules]), lambda x: x.isNotNull())
    return requests.select("id", F.explode(errors).alias("error"))
