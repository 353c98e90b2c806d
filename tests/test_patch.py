import pytest
from pyspark.sql import functions as F

from diffloom.functions import text as T
from diffloom.operators import ledger as L
from diffloom.operators import patch as P

HEAD = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n"


def read(spark, text):
    kind = "binary" if isinstance(text, bytes) else "string"
    return P.Patch(spark.createDataFrame([("p", text)], f"path string, patch {kind}"))


def lines(spark, text):
    return sorted((r.side, r.line, r.ordinal, r.content) for r in read(spark, text).lines.collect())


def errors(spark, text):
    return sorted((r.rec, r.hunk_no, r.error) for r in read(spark, text).errors.collect())


def header(spark, text):
    (row,) = read(spark, text).files.collect()
    return row


def test_replace(spark):
    text = HEAD + "@@ -1,2 +1,3 @@ def f\n one\n-two\n+2\n+3\n"
    assert lines(spark, text) == [("after", 2, 1, "2"), ("after", 3, 2, "3"), ("before", 2, 0, "two")]
    assert errors(spark, text) == []
    (head,) = read(spark, text).heads.collect()
    assert (head.heading, head.raw_patch_bytes) == ("def f", len("@@ -1,2 +1,3 @@ def f\n one\n-two\n+2\n+3\n"))


def test_content_that_looks_like_a_header(spark):
    text = HEAD + "@@ -1 +1 @@\n--- removed\n+++ added\n"
    assert lines(spark, text) == [("after", 1, 1, "++ added"), ("before", 1, 0, "-- removed")]
    assert header(spark, text).old_path == "x.py"


def test_missing_line_feeds_and_carriage_returns(spark):
    text = HEAD + "@@ -1 +1 @@\n-old\r\n\\ No newline at end of file\n+new\n\\ No newline at end of file\n"
    rows = read(spark, text).lines.orderBy("ordinal").collect()
    assert [(r.content, r.no_newline, r.block) for r in rows] == [("old\r", True, 0), ("new", True, 0)]
    assert errors(spark, text) == []


def test_bytes_that_are_no_text(spark):
    import hashlib

    rows = read(spark, HEAD.encode() + b"@@ -0,0 +1,2 @@\n+a\xffb\xe2\x82\n+\xc3\xa9\n").lines.orderBy("ordinal").collect()
    assert [(r.content, r.undecodable) for r in rows] == [("a\\xffb\\xe2\\x82", True), ("é", False)]
    assert rows[0].content_hash == hashlib.sha256(b"a\xffb\xe2\x82").hexdigest()


@pytest.mark.parametrize(
    "text, found",
    [
        ("junk\n" + HEAD + "@@ -1 +1 @@\n-a\n+b\n", [(0, 0, "data before the first record")]),
        ("not a patch\n", [(0, 0, "data before the first record")]),
        (HEAD + "@@ -1,9 +1 @@\n-a\n+b\n", [(1, 1, "totals differ from the header")]),
        (HEAD + "@@ -1 +1 @@\n\\ No newline at end of file\n-a\n+b\n", [(1, 1, "orphan marker")]),
        (HEAD + "@@ -1 +1 @@\n-a\n\\ No newline at end of file\n\\ No newline at end of file\n+b\n", [(1, 1, "orphan marker")]),
        (HEAD + "@@ -1 +1 @\n-a\n+b\n", [(1, 1, "malformed hunk header")]),
        (HEAD + "@@ -1 +1 @@\n-a\n?\n+b\n", [(1, 1, "unexpected line")]),
        (HEAD + "@@ -1 +1 @@\n-a\n\n+b\n", [(1, 1, "empty line")]),
        (HEAD.replace("---", "index 12..zz\n---") + "@@ -1 +1 @@\n-a\n+b\n", [(1, 0, "malformed index line")]),
        ('diff --git "a/x b/x\n--- "a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n', [(1, 0, "quoted path")]),
        ("diff --git a/../x b/../x\n--- a/../x\n+++ b/../x\n@@ -1 +1 @@\n-a\n+b\n", [(1, 0, "unsafe path")]),
        ("", []),
        (None, []),
    ],
)
def test_errors(spark, text, found):
    assert errors(spark, text) == found


def test_checked(spark):
    with pytest.raises(ValueError, match="totals differ"):
        P.checked_patch(spark.createDataFrame([("p", HEAD + "@@ -1,9 +1 @@\n-a\n+b\n")], "path string, patch string"))


def test_deleted_file_keeps_its_lines(spark):
    text = "diff --git a/x b/x\ndeleted file mode 100644\nindex 1234567..0000000\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-old\n"
    h = header(spark, text)
    assert (h.old_path, h.new_path, h.status, h.old_blob, h.new_blob, h.old_mode, h.new_mode) == ("x", None, "deleted", "1234567", None, "100644", None)
    (row,) = P.parse_patch(spark.createDataFrame([("p", text)], "path string, patch string")).collect()
    assert (row.path, row.side, row.line, row.content) == ("x", "before", 1, "old")


@pytest.mark.parametrize(
    "text, facts",
    [
        ('diff --git "a/t\\tab\\n\\"q\\"\\\\" "b/t\\tab\\n\\"q\\"\\\\"\nold mode 100644\nnew mode 100755\n', ('t\tab\n"q"\\', 't\tab\n"q"\\', "modified", "100644", "100755")),
        ('diff --git "a/\\303\\251.py" "b/\\303\\251.py"\nold mode 100644\nnew mode 100755\n', ("é.py", "é.py", "modified", "100644", "100755")),
        ("diff --git a/a b/c b/a b/c\nold mode 100644\nnew mode 100755\n", ("a b/c", "a b/c", "modified", "100644", "100755")),
        ("diff --git a/a/x b/b/x\nsimilarity index 100%\nrename from a/x\nrename to b/x\n", ("a/x", "b/x", "renamed", None, None)),
        ("diff --git a/x b/y\nsimilarity index 80%\ncopy from x\ncopy to y\nindex aa..bb 100644\n", ("x", "y", "copied", "100644", "100644")),
        ("diff --git a/e b/e\nnew file mode 100644\nindex 0000000..e69de29\n", (None, "e", "added", None, "100644")),
    ],
)
def test_headers(spark, text, facts):
    h = header(spark, text)
    assert (h.old_path, h.new_path, h.status, h.old_mode, h.new_mode) == facts


def kinds(spark, text):
    read_ = read(spark, text)
    files = read_.files.withColumns({"doc_id": F.col("rec"), "path": F.coalesce("new_path", "old_path")})
    hunks = L.with_ids(read_.hunks.withColumn("doc_id", F.col("rec")).withColumn("path", F.col("key")), files)
    return [(r.kind, r.metadata) for r in L.units(files, hunks).orderBy("unit_no").collect()]


def test_units(spark):
    text = "diff --git a/x b/y\nold mode 100644\nnew mode 100755\nsimilarity index 90%\nrename from x\nrename to y\nBinary files a/x and b/y differ\n"
    assert [k for k, _ in kinds(spark, text)] == ["binary", "mode", "rename"]
    text = "diff --git a/s b/s\nindex 1..2 160000\n--- a/s\n+++ b/s\n@@ -1 +1 @@\n-Subproject commit 1\n+Subproject commit 2\n"
    assert kinds(spark, text) == [("submodule", '{"new_object":"2","old_object":"1"}')]
    assert [k for k, _ in kinds(spark, "diff --git a/n b/n\nindex 1..2 100644\n")] == ["unsupported"]
    assert [k for k, _ in kinds(spark, HEAD + "@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file\n")] == ["text"]


@pytest.mark.parametrize("name", ["plain/x.py", 'tab\t"quote"\\', "é ü/ß.txt", "a b"])
def test_quoting(spark, name):
    row = spark.createDataFrame([(name,)], "p string").select(T.quoted(F.col("p"), "a/").alias("q")).withColumn("back", T.display(T.unquoted(T.byte_text(F.encode("q", "UTF-8"))))).first()
    assert row.back == "a/" + name and row.q.isascii()


def test_stream(spark, tmp_path):
    from diffloom.streaming.patches import ledger_stream

    (tmp_path / "in").mkdir()
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n"
    for name in "ab":
        (tmp_path / "in" / name).write_text(text)
        ledger_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("text", ["", "plain name", 'a"b\\c', "tab\there", "é\n\x7f~!", '"', "\\\\", "x\x00y \U0001f600 end", "#[]^"])
def test_quoting_by_runs(spark, text):
    """As each character on its own: bytes outside printable ASCII as three octal digits."""
    rows = spark.createDataFrame([(text,)], "t string").select(T.quoted(F.col("t"), "a/").alias("q")).select("q", T.display(T.unquoted(T.byte_text(F.encode("q", "UTF-8")))).alias("back"))
    want = "".join("\\" + chr(b) if chr(b) in '"\\' else chr(b) if 32 <= b <= 126 else f"\\{b:03o}" for b in f"a/{text}".encode())
    assert tuple(rows.head()) == (f'"{want}"', f"a/{text}")


@pytest.mark.parametrize("name", ["patch_errors", "patch_ledger"])
def test_documents_are_read_once_for_patches(spark, name):
    """What a query plans after the patches are written reads those, and documents no more."""
    from diffloom.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
