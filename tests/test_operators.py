import shutil
import json

import pytest
from pyspark.sql import functions as F

from diffloom.functions import schema, symbols
from diffloom.functions import text as T
from diffloom.functions.ids import normal_path, stable_id
from diffloom.operators import citations, graph, ledger, release, scopes, validate
from diffloom.sources import snapshot, tables

CHANGED = "doc_id long, path string, old_path string, new_path string, hunk_no long, unit_id string, hunk_id string, block long, side string, line long, ordinal long, content string, content_hash string, no_newline boolean"


def changed(spark, rows):
    full = [(1, "p", "p", "p", 1, "u", "h", block, side, line, k, text, text, False) for k, (block, side, line, text) in enumerate(rows)]
    return spark.createDataFrame(full, CHANGED)


def test_spans_link_only_inside_a_block(spark):
    out = ledger.replacements(ledger.spans(changed(spark, [(0, "before", 1, "a"), (0, "after", 1, "b"), (1, "before", 3, "c"), (2, "after", 4, "d")]))).orderBy("span_no").collect()
    assert [r.replacement_span_id is not None for r in out] == [True, True, False, False]
    assert out[0].replacement_span_id == out[1].span_id and out[1].replacement_span_id == out[0].span_id


def test_two_blocks(spark):
    rows = [(0, "before", 1, "a"), (0, "after", 1, "b"), (1, "before", 3, "c"), (1, "before", 4, "d"), (1, "after", 3, "e"), (1, "after", 4, "f"), (1, "after", 5, "g")]
    out = ledger.replacements(ledger.spans(changed(spark, rows)))
    assert [(r.n_lines, r.replacement_span_id is not None) for r in out.orderBy("span_no").collect()] == [(1, True), (1, True), (2, True), (3, True)]
    assert ledger.asymmetric(out).count() == 0
    assert ledger.line_rows(out).select("line_id").distinct().count() == 7


def test_null_and_empty_fields_have_other_ids(spark):
    rows = spark.createDataFrame([(None, "x"), ("", "x"), ('"]', None)], "a string, b string")
    assert rows.select(stable_id("k", "a", "b")).distinct().count() == 3


@pytest.mark.parametrize(
    "path, status, kinds, formatting, want",
    [
        ("a/Cargo.lock", "modified", ["text"], False, ("dependency", "extracted")), ("generated/a.py", "modified", ["text"], False, ("generated", "inferred")), ("lib/a.min.js", "modified", ["text"], False, ("generated", "inferred")), ("schema/a.txt", "modified", ["text"], False, ("schema", "inferred")),
        ("api.schema.json", "modified", ["text"], False, ("schema", "inferred")), (".eslintrc", "modified", ["text"], False, ("configuration", "inferred")), (".github/run.sh", "modified", ["text"], False, ("configuration", "inferred")), ("test_a.py", "modified", ["text"], False, ("tests", "inferred")),
        ("docs/a.py", "modified", ["text"], False, ("docs", "inferred")), ("a.txt", "modified", ["text"], False, ("unresolved", "unresolved")), ("my-requirements.txt", "modified", ["text"], False, ("unresolved", "unresolved")), ("a.py", "modified", ["text"], True, ("formatting", "inferred")),
        ("a.py", "modified", ["text"], False, ("behavioral", "inferred")), ("a.py", "modified", ["copy"], False, ("structural", "extracted")), ("a.py", "modified", ["mode"], False, ("mode", "extracted")), ("a.py", "added", ["text", "mode"], False, ("added", "extracted")), ("a.py", "renamed", ["text", "rename"], False, ("rename", "extracted")), ("a.py", "modified", ["unsupported"], False, ("unsupported", "extracted")),
    ],
)
def test_classes(spark, path, status, kinds, formatting, want):
    rows = spark.createDataFrame([(path, status, kinds, formatting)], "path string, status string, kinds array<string>, formatting boolean")
    kind, sure = ledger.classification(F.col("path"), F.col("status"), F.col("kinds"), F.array_contains("kinds", "text"), F.col("formatting"))
    assert tuple(rows.select(kind, sure).first()) == want


def cited(spark, sizes):
    rows = [(1, "after", "p", f"s{k}", k + 1, k + 1, "x" * n, f"source_{k}", "0" * 64) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, side string, path string, span_id string, start_line long, end_line long, text string, citation_id string, content_hash string")


def evidence(rows, most):
    """The document of these citations by the rules, measured by writing it."""
    full, omissions = [], []
    for r in rows:
        again = {"content_hash": r["content_hash"], "end_line": r["end_line"], "kind": citations.SOURCE_RANGE, "path": r["path"], "side": r["side"], "start_line": r["start_line"]}
        full.append({**{k: v for k, v in again.items() if k != "kind"}, "id": r["citation_id"], "omitted": r["omitted"], "retrieval": again if r["omitted"] else None, "text": None if r["omitted"] else r["text"]})
        if r["omitted"]:
            omissions.append({"citation_id": r["citation_id"], "id": "omission_" + "0" * 24, "kind": citations.SOURCE_CONTEXT, "retrieval": again})
    message = {"exceeded": citations.EXCEEDED, "omitted": citations.OMITTED, "omitted_all": citations.OMITTED}.get(rows[0]["outcome"])
    told = [{"actual_bytes": 0, "code": message[0], "message": message[1], "omitted_contexts": len(omissions), "requested_bytes": most}] if message else []
    n = 0
    while True:
        for x in told:
            x["actual_bytes"] = n
        size = len(json.dumps({"citations": full, "diagnostics": told, "metrics": {"evidence_bytes": n, "omitted_source_contexts": len(omissions)}, "omissions": omissions}, sort_keys=True, separators=(",", ":"))) + 1
        if size == n:
            return n
        n = size


@pytest.mark.parametrize("most", [0, 1500, 3000, 4400, 6000, 9000, 20000])
def test_budget_sizes_are_exact(spark, most):
    rows = [r.asDict() for r in citations.budget(cited(spark, [900, 10, 2000, 900, 1200, 3]), most).collect()]
    assert {evidence(rows, most)} == {r["evidence_bytes"] for r in rows}
    (outcome,) = {r["outcome"] for r in rows}
    assert (rows[0]["evidence_bytes"] <= most) == (outcome in ("fits", "omitted"))
    # the largest go first, small ones never: omitting them saves nothing
    gone = {r["citation_id"] for r in rows if r["omitted"]}
    order = ["source_2", "source_4", "source_0", "source_3"]
    assert gone == set(order[: len(gone)])


def test_negative_budget(spark):
    with pytest.raises(ValueError):
        citations.budget(cited(spark, [1]), -1)


def test_innermost_and_tie(spark):
    lines = spark.createDataFrame([(1, 5), (1, 20), (1, 1), (1, 300), (1, 301)], "doc_id long, line long")
    ranges = spark.createDataFrame([(1, "outer", 1, 10), (1, "inner", 4, 6), (1, "x", 15, 30), (1, "y", 15, 30), (1, "long", 100, 900)], "doc_id long, name string, line long, end_line long")
    got = {r.line: (r.symbol, r.how) for r in graph.innermost(lines, ranges).collect()}
    assert got == {5: ("inner", "enclosing"), 20: (None, "unresolved"), 1: ("outer", "direct"), 300: ("long", "enclosing"), 301: ("long", "enclosing")}


def test_closure_of_a_long_chain_and_a_cycle(spark):
    chain = [(k, k - 1) for k in range(1, 131)] + [(500, 501), (501, 500)]
    up = graph.ancestors(spark, spark.createDataFrame(chain, "node long, parent long"))
    assert up.where("node = 130").count() == 131
    assert {r.ancestor for r in up.where("node = 500").collect()} == {500, 501}
    assert up.count() == up.distinct().count()


def test_merge_base(spark):
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("a", "r"), ("b", "r"), ("e", "a")], "node string, parent string")
    pairs = spark.createDataFrame([("c", "d"), ("d", "e")], "left_node string, right_node string")
    assert {(r.left_node, r.n_bases, r.base) for r in graph.merge_bases(spark, edges, pairs).collect()} == {("c", 2, "a"), ("d", 1, "a")}


def test_required_enrichment(spark):
    rows = spark.createDataFrame([("definition", "after", "a", 1, "f", None, "extracted", "p")], ", ".join(f"{c} {'long' if c == 'line' else 'string'}" for c in graph.FACT))
    good = graph.facts(rows)
    assert graph.enriched(good, "required")[0] == "available" and graph.enriched(good, "off")[1].count() == 0
    with pytest.raises(ValueError, match="incomplete"):
        graph.enriched(graph.facts(rows.withColumn("confidence", F.lit("unresolved"))), "required")


@pytest.mark.parametrize(
    "text, field, hit",
    [
        ("The severity is high.", "statement", True), ("The text `severity is high` is gone.", "statement", False), ("Review findings:", "title", True), ("Defects.", "title", True), ("Defects.", "statement", False), ("A stale cache bug exposes old rows.", "after", True),
        ("The change leaks tokens.", "statement", True), ("Users should be notified.", "statement", False), ("This must be rewritten.", "statement", True), ("We suggest a cache.", "statement", True), ("The reviewer field is renamed.", "statement", False), ("Medium risk: loops", "title", True), ("Bug tracker links are shown.", "statement", False),
    ],
)
def test_policy(spark, text, field, hit):
    rows = spark.createDataFrame([("a", field, text)], "id string, field string, value string")
    assert (validate.policy_errors(rows).count() > 0) == hit


@pytest.mark.parametrize("text, doubt", [("It probably works.", True), ("Released in May.", False), ("May fail.", True), ("it may", True), ("It might.", True), ("It appears twice.", True), ("Mayor of the town", False)])
def test_uncertain(spark, text, doubt):
    assert spark.createDataFrame([(text,)], "t string").select(validate.uncertain(F.col("t"))).first()[0] == doubt


def test_symbols():
    python, braces = symbols.PythonSymbols(), symbols.BraceRanges()
    assert list(python.eval("def f():\n    pass\nclass C:\n    def g(self):\n        pass\n")) == [("f", 1, 2, True), ("C", 3, 5, True), ("g", 4, 5, True)]
    assert list(python.eval("def (")) == [(None, None, None, False)] and list(python.eval(None)) == []
    assert list(braces.eval("a {\n '}' /* { */ // }\n}\n")) == [(1, 2, 3)]
    assert list(braces.eval("{ }}")) == [] and list(braces.eval("'{")) == []


def test_scopes(spark):
    commits = spark.createDataFrame([("r", []), ("a", ["r"]), ("b", ["r"]), ("m", ["a", "b"])], "sha string, parents array<string>")
    refs = spark.createDataFrame([("HEAD", "m"), ("side", "b")], "name string, sha string")
    rows = [(1, True, False, None, None, None, None, None), (2, False, False, "m", None, None, None, None), (3, False, False, "m", None, None, None, 2), (4, False, False, "r", None, None, None, None), (5, False, False, None, "a...b", None, None, None), (6, False, False, None, "a..b", None, None, None), (7, False, False, None, None, "side", None, None), (8, True, True, None, None, None, None, None), (9, False, False, None, "a..zz", None, None, None), (10, False, False, None, None, None, None, None), (11, False, False, None, None, None, 1, None)]
    asked = spark.createDataFrame(rows, "id long, staged boolean, unstaged boolean, commit string, range string, branch string, pr long, parent long")
    requests = spark.createDataFrame([(1, "a", "b")], "number long, base string, head string")
    got = {r.id: (r.base, r.target, r.error) for r in scopes.resolved(spark, asked, refs, commits, requests).collect()}
    assert got[1] == ("m", None, None) and got[2][2] == "a merge commit needs a parent" and got[3] == ("b", "m", None) and got[4] == (scopes.EMPTY_TREE, "r", None)
    assert got[5] == ("r", "b", None) and got[6] == ("a", "b", None) and got[7] == ("b", "m", None) and got[8][2] == "comparison modes exclude each other"
    assert got[9][2] == "unknown revision zz" and got[10] == ("m", None, None) and got[11] == ("r", "b", None)


def test_store_and_runs(spark, tmp_path):
    store, built = tables.Store(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.range(3)

    assert store.keep("k1", build, hash="a").count() == 3 and store.keep("k1", build, hash="a").count() == 3 and len(built) == 1
    assert store.keep("k1", build, hash="b").count() == 3 and len(built) == 2
    with pytest.raises(ValueError):
        store.keep("../x", build)
    runs = tables.Runs(spark, str(tmp_path))
    run = runs.begin("c", 10)
    with pytest.raises(ValueError):
        runs.finish(run, "other")
    runs.finish(run, "c")
    assert runs.state(run).status == "complete" and runs.state("none") is None
    with pytest.raises(ValueError):
        runs.finish(run, "c")


def test_run_artifacts(spark, tmp_path):
    runs = tables.Runs(spark, str(tmp_path))
    run = runs.begin("c", 10, lines=spark.range(5), units=spark.range(2))
    assert runs.read(run, "lines").count() == 5 and sorted(r.name for r in runs.artifacts(run).collect()) == ["lines", "units"]
    with pytest.raises(ValueError, match="no artifact"):
        runs.read(run, "other")
    with pytest.raises(ValueError, match="no name"):
        runs.begin("c", 10, **{"../x": spark.range(1)})
    runs.finish(run, "c", report=spark.range(1))
    assert runs.read(run, "report").count() == 1 and runs.state(run).status == "complete"
    run = runs.begin("c", 10, lines=spark.range(5))
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/artifacts/{run}/lines")
    assert runs.changed(run) == ["lines"]
    with pytest.raises(ValueError, match="have changed: lines"):
        runs.finish(run, "c")
    assert runs.state(run).status == "awaiting_explanation"
    shutil.rmtree(f"{tmp_path}/artifacts/{run}/lines")
    assert runs.changed(run) == ["lines"]


def test_load_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    assert tables.load_json(spark, str(tmp_path / "a.json"), "a long").first().a == 1
    (tmp_path / "b.json").write_text("[")
    with pytest.raises(Exception):
        tables.load_json(spark, str(tmp_path / "b.json"), "a long").collect()


def test_schema_keywords(spark):
    rows = spark.createDataFrame([(1, '{"a":[1,"x"],"b":2}'), (2, "{"), (3, '{"a":[]}')], "id long, body string")
    rule = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}, "minItems": 1}, "b": {"type": "integer", "minimum": 3}}}
    assert {(r.id, r.path) for r in schema.schema_errors(rows, "id", "body", rule).collect()} == {(1, "$.a[1]"), (1, "$.b"), (2, "$"), (3, "$.a")}
    with pytest.raises(ValueError):
        schema.schema_errors(rows, "id", "body", {"format": "date"})


def test_nested_leaves(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":["x",{"c":"y"}]},"n":null,"run_seconds":{"k":"z"}}')], "id long, body string")
    found = release.leaves(rows, "id", "body")
    assert {(r.path, r.value) for r in found.collect()} == {("$.a.b[0]", "x"), ("$.a.b[1].c", "y"), ("$.run_seconds.k", "z")}
    assert {r.path for r in release.semantic_leaves(found, F.lit("/r")).collect()} == {"$.a.b[0]", "$.a.b[1].c"}


def test_canonical_json(spark):
    text = "é\n\U0001f600 \"q\" \\"
    (got,) = spark.createDataFrame([(text,)], "t string").select(T.canonical_json(F.struct(F.lit(None).cast("string").alias("n"), "t"))).first()
    assert got == json.dumps({"n": None, "t": text}, sort_keys=True, separators=(",", ":")) + "\n"


def test_paths(spark):
    paths = {"a/b": ("a/b", True), "/a": (None, False), "../a": (None, False), "a\0b": (None, True), "x/.env": ("x/.env", False), "k.pem": ("k.pem", False), ".git/x": (".git/x", False)}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", normal_path("p").alias("n"), snapshot.safe_path("p").alias("s")).collect()
    assert {r.p: (r.n, r.s) for r in rows} == paths


def test_pins_and_headings(spark):
    texts = spark.createDataFrame([("a==1 b==2 b==2",)], "text string")
    pins = spark.createDataFrame([("a==1",), ("b==2",), ("c==3",)], "pin string")
    assert {(r.pin, r.n) for r in release.pinned(texts, pins).collect()} == {("b==2", 2), ("c==3", 0)}
    assert spark.createDataFrame([("# A\ntext\n## B",)], "t string").select(release.shifted_headings(F.col("t"))).first()[0] == "## A\ntext\n### B"
