"""WARC archives: a writer and a splittable reader.

Each record is a gzip member of its own. Reading splits every file into byte
ranges: a task scans its range for the gzip magic and decodes each candidate:
a member is valid if it is whole, its checksum holds and it begins with a WARC
version line and headers that give the length of its block. The task owns the
records that start inside its range and reads past its end where the last one
needs it. Behind a valid member the next one begins at once.

Where a range begins inside a member, a payload may itself hold valid members,
stored uncompressed. So the first candidate of a range must lead from member
to member to the range's end; one that comes to something else on the way is
taken only if no later one gets so far. A damaged member is skipped.

Among records with equal payloads the one with the smallest page_id is a
response, the others are revisits that refer to it.

Writers put a file under a name of their own and move it into place, so a task
that is run again replaces nothing and leaves no second copy. Null html is an
empty payload. A null page_id is written as an empty one; it is no one's
response if others have the same payload. Repeated page_ids are separate
records. Extra columns are ignored; an empty table makes no file and gives no
record. Header names are read in any case, with or without a space behind the
colon; a record without a type or with a length that is no number is damaged.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Bytes of a range that is scanned at once, and ranges of a task where there are many.
RANGE, RANGES = 8 << 20, 128
STEP = 1 << 20
RECORD = "path string, offset long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def filesystem(at: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(at) if "://" in at or at.startswith("file:") else (fs.LocalFileSystem(), at)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers by lower-case name, and the block; None for what is no record."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    if not end or not head.startswith(VERSION):
        return None
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded header goes on
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return None
        name = name.strip().lower()
        fields[name] = value.strip()
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or int(length) > len(rest) or not fields.get("warc-type"):
        return None
    return fields, rest[: int(length)]


def _clean(value) -> str:
    return "" if value is None else "".join(c if " " <= c else "%%%02X" % ord(c) for c in str(value))


def write_archives(pages: DataFrame, to: str) -> DataFrame:
    """Writes pages (page_id, uri, payload, payload_digest, response_id) and returns path and length of each file."""

    def run(batches):
        files, at = filesystem(to)
        name = f"{at}/{uuid.uuid4().hex}"
        length = 0
        files.create_dir(at, recursive=True)
        with files.open_output_stream(name + ".open") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    page, payload, first = row["page_id"], row["payload"] or b"", row["response_id"]
                    revisit = first is not None and first != page
                    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{_clean(page)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(row["uri"])), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(len(payload)))]
                    if revisit:
                        head += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    length += out.write(record([*head, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n" + (b"" if revisit else payload)))
        if length:
            files.move(name + ".open", name + ".warc.gz")
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{name.rsplit('/', 1)[1]}.warc.gz"], "length": [length]})
        else:
            files.delete_file(name + ".open")

    return pages.mapInArrow(run, "path string, length long")


class Source:
    """An open file that is read in windows."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.window = file, size, 0, b""

    def ahead(self, at: int) -> bytes:
        """What is held from this place on, at least some bytes unless the file ends."""
        if not self.base <= at < self.base + len(self.window):
            self.base, self.window = at, self.file.read_at(min(STEP, self.size - at), at) if at < self.size else b""
        return self.window[at - self.base :]

    def magic(self, at: int, end: int) -> int | None:
        """The next place before end where the magic stands."""
        while at < end:
            held = self.ahead(at)
            if len(held) < len(MAGIC):  # it may lie across the window's edge
                held = self.file.read_at(min(STEP, self.size - at), at)
                self.base, self.window = at, held
            k = held.find(MAGIC)
            if k >= 0:
                return at + k if at + k < end else None
            if at + len(held) >= self.size:
                return None
            at += max(1, len(held) - len(MAGIC) + 1)
        return None

    def member(self, at: int) -> tuple[int, tuple[dict[str, str], bytes]] | None:
        """Where the member at this place ends, and its record, if it is a whole valid one."""
        unpack, out, where, good = zlib.decompressobj(31), [], at, False
        try:
            while not unpack.eof:
                held = self.ahead(where)
                if not held:
                    return None
                out.append(unpack.decompress(held))
                where += len(held)
                if not good and sum(map(len, out)) >= len(VERSION):
                    good = b"".join(out).startswith(VERSION)
                    if not good:
                        return None
        except zlib.error:
            return None
        found = parse(b"".join(out))
        return found and (where - len(unpack.unused_data), found)

    def reaches(self, at: int, end: int) -> int:
        """How far members follow each other from this place, to end or the file's end at most."""
        while at < min(end, self.size) and self.ahead(at).startswith(MAGIC) and (found := self.member(at)):
            at = found[0]
        return at

    def first(self, begin: int, end: int) -> int | None:
        """Where the range's first record starts."""
        best, far, at = None, -1, begin
        while (k := self.magic(at, end)) is not None:
            reached = self.reaches(k, end)
            if reached >= min(end, self.size):
                return k
            if reached > max(far, k):
                best, far = k, reached
            # what a chain has passed needn't be tried again
            at = max(k + 1, reached)
        return best


def members(file, begin: int, end: int, size: int):
    """(offset, record) of the records that start in [begin, end)."""
    source = Source(file, size)
    at = source.first(begin, end) if begin else source.magic(0, end)
    while at is not None and at < end:
        found = source.member(at) if source.ahead(at).startswith(MAGIC) else None
        if found:
            yield at, found[1]
            at = found[0]
        else:
            at = source.magic(at + 1, end)


def read_archives(files: DataFrame, span: int = RANGE) -> DataFrame:
    """The records of files (path, length), each read by the task whose byte range holds its first byte."""
    ranges = files.select("path", F.col("length").alias("size"), F.expr(f"explode(sequence(0L, greatest(length - 1, 0L), {span}L))").alias("begin"))
    # a stated number, so that adaptive execution doesn't put the few small rows into one task; many ranges share tasks
    n = ranges.count()
    ranges = ranges.repartition(max(1, min(n, 4 * files.sparkSession.sparkContext.defaultParallelism), -(-n // RANGES)))

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                disk, at = filesystem(part["path"])
                rows = []
                with disk.open_input_file(at) as source:
                    for offset, (head, block) in members(source, part["begin"], min(part["begin"] + span, part["size"]), part["size"]):
                        kind = head["warc-type"]
                        # what stands behind the headers of a response; other records have their block as payload
                        payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") and block.startswith(b"HTTP/") else block
                        told = head.get("x-payload-length", "")
                        rows.append((part["path"], offset, kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest(payload), (int(told) if told.isascii() and told.isdigit() else None) if kind == "revisit" else len(payload), None if kind == "revisit" else payload))
                        if len(rows) == 64:
                            yield _records(rows)
                            rows = []
                yield _records(rows)

    return ranges.mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "offset", "record_type", "record_id", "uri", "refers_to", "payload_digest", "payload_length", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def archive(spark: SparkSession, pages: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(files, records): writes pages (page_id, url, html) as archives in the shared folder and reads them back.

    Payloads of fewer than least bytes are all responses.
    """
    scratch = Scratch(spark, "warc")
    raw = pages.select("page_id", F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))

    def named(batches):
        for batch in batches:
            yield batch.append_column("payload_digest", pa.array([digest(x.as_buffer().to_pybytes()) for x in batch.column("payload")], pa.string()))

    named_rows = raw.mapInArrow(named, "page_id long, uri string, payload binary, payload_digest string")
    first = named_rows.where(F.length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n"))
    pairs = scratch.keep(first.where("n > 1").select("payload_digest", "response_id"))
    linked = named_rows.join(pairs, "payload_digest", "left")
    files = scratch.keep(write_archives(linked.select("page_id", "uri", "payload", "payload_digest", "response_id"), f"{scratch.base}/archives"))
    return files, read_archives(files)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = archive(spark, table(spark, sf_dir, "pages"))
    page = "CAST(nullif(regexp_extract({0}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS LONG)"
    return records.selectExpr(f"{page.format('record_id')} AS page_id", "payload_length AS payload_bytes", "payload_digest", "record_type", f"{page.format('refers_to')} AS refers_to")


#: The digits of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What the archives must give back, from the pages alone; five hexadecimal digits are four of base 32.
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), h AS (SELECT *, sha1(payload) AS hash, min(page_id) OVER (PARTITION BY payload) AS response FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hash, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, list_aggregate(list_transform(parts, lambda n: substr('{BASE32}', (n // 32768) % 32 + 1, 1) || substr('{BASE32}', (n // 1024) % 32 + 1, 1) || substr('{BASE32}', (n // 32) % 32 + 1, 1) || substr('{BASE32}', n % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM b
"""
