import base64
import hashlib
import io
import threading
import zipfile

import pytest

from diffloom.operators import patch
from diffloom.sources import archives, guard, patch_files, tables


def test_large_patches_are_read_in_parts(spark, tmp_path):
    one = b"diff --git a/x%d b/x%d\nindex aa..bb 100644\n--- a/x%d\n+++ b/x%d\n@@ -1,2 +1,2 @@\n \xff keep\n-diff --git a/no b/no\n+new %s\n"
    body = b"".join(one % (k, k, k, k, b"y" * (k % 300)) for k in range(3000))
    (tmp_path / "p").mkdir()
    files = {"big.patch": body, "small.patch": one % (1, 1, 1, 1, b"z"), "before.patch": b"From: me\n\n" + one % (2, 2, 2, 2, b"z"), "none.patch": b"no record", "empty.patch": b"", "bare.patch": (one % (3, 3, 3, 3, b"z"))[:-1]}
    for name, text in files.items():
        (tmp_path / "p" / name).write_bytes(text)
    whole = patch.records(spark.createDataFrame(list(files.items()), "key string, patch binary"), "key", "patch")
    want = sorted((r.key, r.rec, r.raw) for r in whole.collect())
    for size in ("128m", "40k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = patch_files.patch_records(spark, str(tmp_path / "p"))
            assert sorted((r.key, r.rec, r.raw) for r in read.collect()) == want
            n = spark.read.option("lineSep", "\ndiff --git ").text(str(tmp_path / "p")).rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert n > 8
    lines = lambda p: sorted(map(str, p.text_lines.collect()))
    assert lines(patch.Patch.of(patch_files.patch_records(spark, str(tmp_path / "p")))) == lines(patch.Patch.of(whole))


def wheel(members, record=None, raw=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        rows = []
        for name, text in members.items():
            z.writestr(name, text)
            digest = base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode().rstrip("=")
            rows.append(f"{name},sha256={digest},{len(text.encode())}")
        rows.append("x-1.dist-info/RECORD,,")
        z.writestr("x-1.dist-info/RECORD", "\n".join(rows if record is None else record(rows)) + "\n")
        for name in raw or ():
            z.writestr(name, "extra")
    return out.getvalue()


def test_wheels(spark, tmp_path):
    files = {"x/__init__.py": "é = 1\n", 'x/a,"b".py': "", "x-1.dist-info/METADATA": "Metadata-Version: 2.1\nName: x\nLicense: MIT\n OR Apache\nRequires-Dist: y\n\nbody: no\n", "x-1.dist-info/licenses/LICENSE": "Permission is hereby granted, free of charge"}
    quoted = lambda rows: [r.replace('x/a,"b".py', '"x/a,""b"".py"') for r in rows]
    broken = {
        "good.whl": wheel(files, quoted), "missing.whl": wheel(files, lambda r: [*quoted(r), "gone.py,sha256=" + "A" * 43 + ",1"]), "unlisted.whl": wheel(files, lambda r: quoted(r)[1:]), "twice.whl": wheel(files, lambda r: [quoted(r)[0], *quoted(r)]),
        "other.whl": wheel(files, lambda r: [quoted(r)[0].replace(",7", ",8"), *quoted(r)[1:]]), "hash.whl": wheel(files, lambda r: ["x/__init__.py,sha256=" + "A" * 43 + ",7", *quoted(r)[1:]]), "nohash.whl": wheel(files, lambda r: ["x/__init__.py,,", *quoted(r)[1:]]),
        "unsafe.whl": wheel(files, quoted, ["../up"]), "md5.whl": wheel(files, lambda r: ["x/__init__.py,md5=abc,7", *quoted(r)[1:]]), "text.whl": b"no archive", "cut.whl": wheel(files, quoted)[:-30], "nolist.zip": None,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "a")
    broken["nolist.zip"] = out.getvalue()
    for name, raw in broken.items():
        (tmp_path / name).write_bytes(raw)
    members = tables.written(spark, archives.members(archives.archives(spark, str(tmp_path))), "members")
    errors = {}
    for r in archives.wheel_errors(members).collect():
        errors.setdefault(r.archive, set()).add((r.path, r.error))
    assert "good.whl" not in errors
    assert errors["missing.whl"] == {("gone.py", "missing")} and errors["unlisted.whl"] == {("x/__init__.py", "not listed")} and errors["twice.whl"] == {("x/__init__.py", "listed twice")}
    assert errors["other.whl"] == {("x/__init__.py", "other size")} and errors["hash.whl"] == {("x/__init__.py", "other content")} and errors["nohash.whl"] == {("x/__init__.py", "no hash")}
    assert errors["unsafe.whl"] == {("../up", "unsafe path")} and errors["md5.whl"] >= {("x/__init__.py", "no SHA-256")} and errors["text.whl"] == errors["cut.whl"] == {(None, "no archive")} and errors["nolist.zip"] >= {(None, "0 lists of files")}
    told = {r.name: r.value for r in archives.metadata(members.where("archive = 'good.whl'")).collect()}
    assert told == {"metadata-version": "2.1", "name": "x", "license": "MIT OR Apache", "requires-dist": "y"}
    own = {r.path: (r.bytes, r.hash) for r in members.where("archive = 'good.whl'").collect()}
    assert own["x/__init__.py"] == (7, hashlib.sha256("é = 1\n".encode()).hexdigest())


def test_inputs_that_change_are_noticed(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(10).write.parquet(at)
    with guard.unchanged(spark, at) as before:
        assert spark.read.parquet(at).count() == 10
    assert before[0] > 0
    with pytest.raises(guard.Changed), guard.unchanged(spark, at):
        spark.range(5).write.mode("append").parquet(at)
    read = spark.read.parquet(at)
    assert guard.consistent(lambda: tables.written(spark, read, "copy"), read).count() == 15

    def meanwhile():
        out = tables.written(spark, read, "copy")
        spark.range(3).write.mode("append").parquet(at)
        return out

    with pytest.raises(guard.Changed):
        guard.consistent(meanwhile, read)


def test_store_versions(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "s"))
    assert store.current("k") is None and store.status() == []

    def killed():
        spark.range(3).write.parquet(str(tmp_path / "s/k/versions/lost"))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.keep("k", killed, hash="a")
    assert store.current("k") is None
    first = store.keep("k", lambda: spark.range(4), hash="a")
    second = store.keep("k", lambda: spark.range(5), hash="b")
    assert first.count() == 4 and second.count() == 5  # readers of an older version still have theirs
    told = store.status()
    assert [(x["key"], x["facts"], x["versions"]) for x in told] == [("k", {"key": "k", "hash": "b"}, 3)] and told[0]["bytes"] > 0
    assert store.vacuum("k") == 2 and store.keep("k", lambda: 1 / 0, hash="b").count() == 5
    assert store.clear("k") == 1 and store.clear() == 0 and store.status() == []


def test_writers_at_once(spark, tmp_path):
    store, built, got, gate = tables.Store(spark, str(tmp_path / "s")), [], [], threading.Barrier(4)

    def build(n):
        def run():
            built.append(n)
            gate.wait(60)
            return spark.range(n)

        return run

    def write(n, facts):
        got.append((facts, store.keep("k", build(n), hash=facts).count()))

    threads = [threading.Thread(target=write, args=(n, "same" if n < 3 else "other")) for n in (2, 2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(built) == 4 and {n for f, n in got if f == "same"} == {2} and {n for f, n in got if f == "other"} <= {3, 4}
    assert store.current("k")["facts"]["hash"] in ("same", "other")
