"""Members of ZIP archives (wheels among them), and what their own lists of files say.

An archive is one row of a binary file source; its directory is read where the
row is, a member at a time, in chunks, so that a task holds an archive but not what it
unpacks to.
"""

from __future__ import annotations

import base64
import csv
import hashlib
import io
import sys
import zipfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that are unpacked at a time, and of a member whose text is kept.
CHUNK, TEXT = 1 << 20, 1 << 20
MEMBER = "archive string, path string, n int, bytes long, hash string, text string, error string"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (the file's name), content of files at path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _members(name: str, content: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n, info in enumerate(z.infolist()):
                if info.is_dir():
                    continue
                digest, size, kept, error = hashlib.sha256(), 0, [], None
                try:
                    with z.open(info) as f:
                        while part := f.read(CHUNK):
                            digest.update(part)
                            size += len(part)
                            if size <= TEXT:
                                kept.append(part)
                    text = b"".join(kept).decode() if size <= TEXT else None
                except UnicodeDecodeError:
                    text = None
                except Exception as e:  # what the decompressors raise has no common class
                    text, error = None, f"{type(e).__name__}: unreadable member"
                yield name, info.filename, n, size, None if error else digest.hexdigest(), text, error
    except (zipfile.BadZipFile, ValueError, EOFError):
        yield name, None, None, None, None, None, "no archive"


def members(archives_: DataFrame) -> DataFrame:
    """The columns of MEMBER for each file in archives (archive, content): its place, unpacked size, SHA-256, its text if it is UTF-8 and no longer than TEXT, and an error if it can't be read.

    What is no archive gives one row with an error; a null content is none.
    """
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in MEMBER.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for row in _members(name, content.as_py() or b""):
                    rows.append(row)
                    held += len(row[5] or "")
                    if held > 8 * TEXT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives_.select("archive", "content").mapInArrow(run, MEMBER)


class RecordRows:
    """path, hash (hex SHA-256, null for none), bytes, error of each row of a wheel's RECORD."""

    def eval(self, text: str):
        try:
            for row in csv.reader(io.StringIO(text or "", newline="")):
                if not row:
                    continue
                if len(row) != 3:
                    yield row[0], None, None, "not three fields"
                    continue
                path, digest, size = row
                kind, _, value = digest.partition("=")
                raw = None
                if digest:
                    try:
                        raw = base64.urlsafe_b64decode(value + "=" * (-len(value) % 4)) if kind == "sha256" else None
                    except ValueError:
                        raw = None
                known = raw is not None and len(raw) == 32
                whole = size.isascii() and size.isdigit() and len(size) < 19
                error = "no SHA-256" if digest and not known else "no size" if size and not whole else None
                yield path, raw.hex() if known else None, int(size) if whole else None, error
        except csv.Error:
            yield None, None, None, "no table"


def record_rows(members_: DataFrame) -> DataFrame:
    """archive, list (its path), path, hash, bytes, error of every row of the RECORD files among members."""
    table = F.udtf(RecordRows, returnType="path string, hash string, bytes long, error string")
    lists = members_.where(F.col("path").rlike(r"^[^/]+\.dist-info/RECORD$")).select("archive", F.col("path").alias("list"), "text")
    return lists.lateralJoin(table(F.col("text").outer())).select("archive", "list", "path", "hash", "bytes", "error")


def wheel_errors(members_: DataFrame) -> DataFrame:
    """archive, path, error: wheels whose files and whose RECORD aren't the same, each once, with equal hashes and sizes, or whose paths are unsafe.

    The list itself and its signatures have no hash. There must be one list.
    """
    rows = members_
    listed = record_rows(rows)
    bad = rows.where("error IS NOT NULL").select("archive", "path", "error").unionByName(listed.where("error IS NOT NULL").select("archive", "path", "error"))
    unsafe = lambda: F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..") | F.col("path").contains("\\")
    one = rows.where("path IS NOT NULL").groupBy("archive").agg(F.count_if(F.col("path").rlike(r"^[^/]+\.dist-info/RECORD$")).alias("lists")).where("lists <> 1").select("archive", F.lit(None).cast("string").alias("path"), F.concat("lists", F.lit(" lists of files")).alias("error"))
    have = rows.where("path IS NOT NULL AND error IS NULL").groupBy("archive", "path").agg(F.count("*").alias("n_have"), F.min("hash").alias("have"), F.min("bytes").alias("size"))
    want = listed.where("error IS NULL").groupBy("archive", "path").agg(F.count("*").alias("n_want"), F.min("hash").alias("want"), F.min("bytes").alias("stated"))
    both = have.join(want, ["archive", "path"], "full")
    bare = F.col("path").rlike(r"^[^/]+\.dist-info/RECORD(?:\.jws|\.p7s)?$")
    error = (
        F.when(unsafe(), "unsafe path").when(F.col("n_have") > 1, "stands twice").when(F.col("n_want") > 1, "listed twice").when(F.col("n_have").isNull(), "missing")
        .when(F.col("n_want").isNull(), F.when(~bare | F.col("path").endswith("RECORD"), "not listed")).when(bare, F.when(F.col("want").isNotNull(), "a list has no hash"))
        .when(F.col("want").isNull(), "no hash").when(F.col("want") != F.col("have"), "other content").when(F.col("stated").isNotNull() & (F.col("stated") != F.col("size")), "other size")
    )
    return both.select("archive", "path", error.alias("error")).where("error IS NOT NULL").unionByName(bad).unionByName(one)


def metadata(members_: DataFrame) -> DataFrame:
    """archive, name, value of the header lines of wheels' METADATA, folded lines joined, in order of n."""
    text = members_.where(F.col("path").rlike(r"^[^/]+\.dist-info/METADATA$")).select("archive", F.regexp_replace(F.regexp_replace("text", r"\r\n", "\n"), r"\n[ \t]+", " ").alias("text"))
    head = F.split(F.split("text", "\n\n", 2)[0], "\n")
    rows = text.select("archive", F.posexplode(head).alias("n", "line")).where(F.col("line").contains(":"))
    return rows.select("archive", "n", F.lower(F.substring_index("line", ":", 1)).alias("name"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))
