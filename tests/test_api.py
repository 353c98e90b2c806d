import json

import pytest

from diffloom import api
from diffloom.functions.schema import schema_errors

PATCH = "diff --git a/app.py b/app.py\nindex aaaa..bbbb 100644\n--- a/app.py\n+++ b/app.py\n@@ -1,2 +1,2 @@\n def f():\n-    return 1\n+    return 2\ndiff --git a/run.sh b/run.sh\nold mode 100644\nnew mode 100755\n"
ITEM = "item_id string, ord long, kind string, title string, before string, after string, has_before boolean, has_after boolean, absence string, statement string, has_statement boolean, references array<string>, confidence string"


@pytest.fixture(scope="module")
def found(spark):
    patches = spark.createDataFrame([("p", PATCH)], "key string, patch string")
    files = spark.createDataFrame([("before", "app.py", "def f():\n    return 1\n"), ("after", "app.py", "def f():\n    return 2\n"), ("before", "run.sh", ""), ("after", "run.sh", "")], "side string, path string, content string")
    return api.analyze(patches, files)


def told(spark, found, owners=None, title="f returns two"):
    ids = [r.line_id for r in found.lines.collect()] + [r.unit_id for r in found.units.where("kind <> 'text'").collect()]
    span = found.spans.first().span_id
    items = spark.createDataFrame([("i1", 1, "behavioral", title, "one", "two", True, True, None, None, False, [span], "extracted")], ITEM)
    return api.Explanation("f returns another number.", items, spark.createDataFrame([(k, e, "i1") for k, e in enumerate(ids if owners is None else owners)], "pos long, evidence_id string, owner_id string"))


def test_evidence(found):
    assert found.lines.count() == 2 and found.spans.count() == 2 and found.hunks.count() == 1
    assert sorted(r.kind for r in found.units.collect()) == ["mode", "text"]
    row = found.metrics().first()
    assert (row.files, row.units, row.changed_lines, row.source_citations, row.raw_patch_bytes) == (2, 2, 2, 2, len(PATCH))
    assert len(row) == 22 and row.evidence_bytes > 0
    assert found.diagnostics().count() == 0 and "### `app.py`" in "\n".join(r.markdown for r in found.markdown().collect())


def test_overview_and_appendix(spark, found):
    page = found.overview("c1")
    assert page.startswith("# Evidence\n\nComparison: `c1`\n\n## Change ledger\n\n2 files · 2 units · 1 hunks · 2 spans · 1 added lines · 1 deleted lines\n")
    assert "- behavioral: 1 units" in page and "- mode: 1 units" in page and "Graph: **disabled**, 0 facts" in page and "Diagnostics" not in page
    assert found.appendix().count() == 0
    patches = spark.createDataFrame([("p", PATCH)], "key string, patch string")
    symbols = spark.createDataFrame([("p#1", "f", 1, 2, "extracted", "python")], "doc_id string, name string, line long, end_line long, confidence string, provenance string")
    graph = api.analyze(patches, found.snapshot_files, symbols=symbols, budget=10)
    told = {r.path: r.markdown for r in graph.appendix().collect()}
    assert "changed_symbol f at `app.py:1`" in told["app.py"] or "enclosing_symbol f at `app.py:1`" in told["app.py"]
    page = graph.overview("c")
    assert "no-changed-lines" in told["run.sh"] and "Graph: **available**" in page and "- **" in page and "(1 files)" in page
    graph.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        graph.lines.count()


def test_undecodable_lines(spark):
    patch = PATCH.encode().replace(b"return 2", b"return \xff")
    rows = spark.createDataFrame([("p", bytearray(patch))], "key string, patch binary")
    side = lambda s, path, body: (s, path, bytearray(body))
    files = spark.createDataFrame([side("before", "app.py", b"def f():\n    return 1\n"), side("after", "app.py", b"def f():\n    return \xff\n"), side("before", "run.sh", b""), side("after", "run.sh", b"")], "side string, path string, content binary")
    found = api.analyze(rows, files)
    bad = found.lines.where("side = 'after'").first()
    assert bad.content == "    return \\xff"
    assert json.loads(found.units.where("kind = 'text'").first().metadata) == {"undecodable_line_ids": [bad.line_id]}


def test_valid_explanation(spark, found):
    row = api.validate_explanation(found, told(spark, found)).first()
    assert (row.line_owned, row.line_total, row.unit_owned, row.unit_total, row.span_ratio, row.citation_count) == (2, 2, 2, 2, 1.0, 1)
    text = api.render_report(found, told(spark, found))
    assert text.startswith("# Explanation\n\nf returns another number.\n") and "- Changed lines: 2/2 (100%)" in text and "_None._" in text


def test_invalid_explanations(spark, found):
    with pytest.raises(ValueError, match="no owner"):
        api.validate_explanation(found, told(spark, found, owners=[found.lines.first().line_id]))
    with pytest.raises(ValueError, match="review-style heading"):
        api.validate_explanation(found, told(spark, found, title="Review findings"))
    with pytest.raises(ValueError, match="unknown evidence"):
        api.validate_explanation(found, told(spark, found, owners=["nothing"]))


def test_wrong_snapshot(spark):
    patches = spark.createDataFrame([("p", PATCH)], "key string, patch string")
    files = spark.createDataFrame([("before", "app.py", "def f():\n    return 1\n"), ("after", "app.py", "def f():\n    return 3\n")], "side string, path string, content string")
    with pytest.raises(ValueError, match="snapshot doesn't have"):
        api.analyze(patches, files)


def test_repository(spark, tmp_path):
    assert api.resolve_repository(spark, str(tmp_path)).endswith(tmp_path.name)
    with pytest.raises(ValueError):
        api.resolve_repository(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("whole", [False, True])
def test_budget_diagnostics(spark, whole):
    patches = spark.createDataFrame([("p", PATCH), ("q", PATCH.split("diff --git a/run")[0].replace("app.py", "b.py"))], "key string, patch string")
    texts = {"before": "def f():\n    return 1\n", "after": "def f():\n    return 2\n"}
    files = spark.createDataFrame([(side, p, t) for side, t in texts.items() for p in ("app.py", "b.py")] + [(s, "run.sh", "") for s in texts], "side string, path string, content string")
    tight = api.analyze(patches, files, budget=300, whole=whole)
    told = [r.asDict() for r in tight.diagnostics().collect()]
    assert len(told) == (1 if whole else 2) and all(r["requested_bytes"] == 300 and r["actual_bytes"] > 300 and r["code"] == "evidence_budget_exceeded" for r in told)
    assert tight.metrics().first().evidence_bytes == sum(r["actual_bytes"] for r in told)
    assert (told[0]["doc_id"] is None) == whole and api.analyze(patches, files, whole=whole).diagnostics().count() == 0


def test_documents_follow_their_schema(spark, found):
    docs = found.documents().cache()
    read = {x["path"]: x for x in (json.loads(r.document) for r in docs.collect())}
    assert [len(read["app.py"][k]) for k in ("units", "spans", "citations")] == [1, 2, 2] and read["run.sh"]["spans"] == [] and read["run.sh"]["units"][0]["kind"] == "mode"
    schema = api.load_schema("evidence")
    assert schema_errors(docs, "doc_id", "document", schema).count() == 0
    body = read["app.py"]
    body["spans"][0]["lines"].append("line_x")
    body["citations"][0]["omitted"] = True
    body["units"][0]["kind"] = "other"
    bad = spark.createDataFrame([(1, json.dumps(body))], "doc_id long, document string")
    assert {(r.path, r.error) for r in schema_errors(bad, "doc_id", "document", schema).collect()} == {("$.spans[0].lines[1]", "does not match its pattern"), ("$.citations[0].text", "is not of type null"), ("$.units[0].kind", "is none of the allowed values")}
    with pytest.raises(ValueError, match="unknown schema"):
        api.load_schema("other")


def test_explanations_from_files(spark, found, tmp_path):
    ids = [r.line_id for r in found.lines.collect()] + [r.unit_id for r in found.units.where("kind <> 'text'").collect()]
    item = {"id": "i1", "kind": "behavioral", "title": "f returns two", "before": "one", "after": "two", "references": [found.spans.first().span_id], "confidence": "extracted"}
    body = {"summary": "f returns another number.", "items": [item], "owners": [{"evidence": e, "item": "i1"} for e in ids]}
    (tmp_path / "good.json").write_text(json.dumps(body))
    assert api.validate_explanation(found, api.load_explanation(spark, str(tmp_path / "good.json"))).first().line_owned == 2
    item["kind"], body["extra"] = "praise", 1
    (tmp_path / "bad.json").write_text(json.dumps(body))
    with pytest.raises(ValueError, match="extra.*is not allowed|is none of the allowed values"):
        api.load_explanation(spark, str(tmp_path / "bad.json"))
