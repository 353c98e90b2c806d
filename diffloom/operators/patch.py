"""Unified patch text to rows, and rows to patch text.

A patch is bytes, held as a string with one character for each byte, so that
content that is no UTF-8 keeps its hash. Records begin at diff headers and
hunks at @@ headers; both are cut by splitting the text, without a window over
a whole patch. Lines are then numbered within their hunk.

Columns of what is read: key, rec (record in the patch, from 1), hunk_no (in
the record, from 1). Nulls and empty patches have no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import normal_path
from ..functions.text import byte_text, display, fenced, let, quoted, raw_bytes, unquoted, well_formed
from .ledger import MARKER, SUBMODULE, of_range

#: The forms of hunk headers and index lines, and the prefixes of other header lines.
HUNK = r"(?sd)^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(.*)$"
INDEX = r"(?d)^index ([0-9a-f]+)\.\.([0-9a-f]+)(?: ([0-7]+))?$"
PREFIXES = {
    "old": "--- ", "new": "+++ ", "index": "index ", "old_mode": "old mode ", "new_mode": "new mode ", "added": "new file mode ", "deleted": "deleted file mode ",
    "rename_from": "rename from ", "rename_to": "rename to ", "copy_from": "copy from ", "copy_to": "copy to ", "similarity": "similarity index ",
}
BINARY = ("Binary files ", "GIT binary patch")


def write_patch(files: DataFrame, hunks: DataFrame, odd: Column | None = None) -> DataFrame:
    """doc_id, path, patch: the patch of each file, with context. odd: whether paths are quoted, by default those of every seventh id.

    Files may have a similarity in hundredths; it is 90 otherwise.
    """
    body = hunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "raw"))), lambda x: x["raw"]), "").alias("body"))
    rows = files.join(body.hint("merge"), "doc_id", "left")
    nested = F.coalesce(F.col("new_mode"), F.col("old_mode")) == SUBMODULE
    body = F.when(nested & F.col("old_blob").isNotNull() & F.col("new_blob").isNotNull(), F.concat(F.lit("@@ -1 +1 @@\n-Subproject commit "), "old_blob", F.lit("\n+Subproject commit "), "new_blob", F.lit("\n"))).otherwise(F.col("body"))
    odd = F.col("doc_id") % 7 == 3 if odd is None else odd
    name = lambda c, prefix="": F.when(odd, quoted(c, prefix)).otherwise(F.concat(F.lit(prefix), c))
    old, new = F.coalesce("old_path", "new_path"), F.coalesce("new_path", "old_path")
    zero = F.lit("0" * 40)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    moved = lambda word: F.concat(line("similarity index ", F.col("similarity") if "similarity" in files.columns else "90", "%"), line(f"{word} from ", name(F.col("old_path"))), line(f"{word} to ", name(F.col("new_path"))))
    same = F.col("old_mode").eqNullSafe(F.col("new_mode"))
    parts = [
        line("diff --git ", name(old, "a/"), " ", name(new, "b/")),
        F.when(F.col("status") == "added", line("new file mode ", F.col("new_mode"))),
        F.when(F.col("status") == "deleted", line("deleted file mode ", F.col("old_mode"))),
        F.when(~same & (F.col("status") == "modified"), F.concat(line("old mode ", F.col("old_mode")), line("new mode ", F.col("new_mode")))),
        F.when(F.col("status") == "renamed", moved("rename")).when(F.col("status") == "copied", moved("copy")),
        F.when(F.col("old_blob").isNotNull() | F.col("new_blob").isNotNull(), line("index ", F.coalesce("old_blob", zero), "..", F.coalesce("new_blob", zero), F.when(same, F.concat(F.lit(" "), "old_mode")).otherwise(""))),
        F.when(F.col("binary"), line("Binary files ", name(old, "a/"), " and ", name(new, "b/"), " differ")),
        F.when(body.isNotNull() & ~F.col("binary"), F.concat(F.when(F.col("old_path").isNull(), line("--- /dev/null")).otherwise(line("--- ", name(old, "a/"))), F.when(F.col("new_path").isNull(), line("+++ /dev/null")).otherwise(line("+++ ", name(new, "b/"))), body)),
    ]
    return rows.select("doc_id", "path", F.array_join(F.array(*parts), "").alias("patch"))


def _trimmed(text: Column) -> Column:
    """Without one line feed at the end."""
    return F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)


def records(patches: DataFrame, key: str = "path", text: str = "patch") -> DataFrame:
    """key, rec, raw: the records of patches (strings or bytes); rec 0 is what stands before the first one, if there is anything."""
    parts = patches.select(F.col(key).alias("key"), F.split(byte_text(F.col(text).cast("binary")), "(?<=\n)(?=diff --git )").alias("parts"))
    before = F.when(F.col("parts")[0].startswith("diff --git "), 1).otherwise(0).alias("before")
    return parts.select("key", before, F.posexplode("parts").alias("p", "raw")).select("key", (F.col("p") + F.col("before")).cast("long").alias("rec"), "raw").where("rec > 0 OR raw <> ''")


def header_paths(value: Column) -> Column:
    """(old, new) of a diff header's two paths as a struct, null where they can't be told apart: of several ways to cut them the only one with equal paths counts."""
    parts = F.split(value, ' (?="?b/)')
    strip = lambda p: F.regexp_replace(p, "^[ab]/", "")
    pair = lambda k: F.struct(strip(unquoted(F.array_join(F.slice(parts, 1, k), " "))).alias("old"), strip(unquoted(F.array_join(F.slice(parts, k + 1, F.size(parts)), " "))).alias("new"))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), pair), lambda x: normal_path(x["old"]).isNotNull() & normal_path(x["new"]).isNotNull())

    def told(every: Column) -> Column:
        equal = F.filter(every, lambda x: x["old"] == x["new"])
        return F.when(F.size(equal) == 1, equal[0]).when(F.size(every) == 1, every[0])

    return F.when(F.size(parts) > 1, let(pairs, told))


def headers(records_: DataFrame, *kept: str) -> DataFrame:
    """key, rec, the kept columns and what the header lines of each record say: paths, status, blobs, modes, similarity, binary, and malformed, the first line that breaks its form."""
    top = F.split(_trimmed(F.split("raw", "(?<=\n)(?=@@ )", 2)[0]), "\n")
    own = ["key", "rec", *kept]
    rows = records_.where("rec > 0").select(*own, F.transform(top, lambda x: F.regexp_replace(x, r"\r\z", "")).alias("lines"))
    # of a repeated header line the last one counts
    begins = lambda p: lambda x: x.startswith(p)
    last = {k: F.try_element_at(F.filter("lines", begins(p)), F.lit(-1)) for k, p in PREFIXES.items()}
    rest = lambda k: F.col(f"{k}_rest")
    named = rows.select(*own, "lines", *[last[k].alias(k) for k in PREFIXES], F.exists("lines", lambda x: x.startswith(BINARY[0]) | x.startswith(BINARY[1])).alias("binary"), header_paths(F.substring(F.col("lines")[0], F.lit(12), F.length(F.col("lines")[0]))).alias("both"))
    named = fenced(named.drop("lines"))
    paths = ("old", "new", "rename_from", "rename_to", "copy_from", "copy_to")
    after = lambda k: F.substring(F.col(k), F.lit(len(PREFIXES[k]) + 1), F.length(k))
    named = fenced(named.select("*", *[after(k).alias(f"{k}_rest") for k in PREFIXES if k not in paths], *[unquoted(after(k)).alias(f"{k}_plain") for k in paths]))
    plain = lambda k: F.col(f"{k}_plain")
    bare = lambda k: F.regexp_replace(plain(k), "^[ab]/", "")
    side = lambda k, moved, other: F.when(F.col(k).isNotNull(), F.when(plain(k) != "/dev/null", bare(k))).otherwise(F.coalesce(*[plain(m) for m in moved], F.col("both")[other]))
    part = lambda i: F.nullif(F.regexp_extract("index", INDEX, i), F.lit(""))
    zero = lambda c: F.when(~c.rlike("^0+$"), c)
    made, gone = F.col("added").isNotNull(), F.col("deleted").isNotNull()
    told = named.select(
        *own, made.alias("made"), gone.alias("gone"),
        F.when(~made, side("old", ("rename_from", "copy_from"), "old")).alias("old_raw"),
        F.when(made | ~gone, side("new", ("rename_to", "copy_to"), "new")).alias("new_raw"),
        F.when(made, "added").when(gone, "deleted").when(F.col("rename_from").isNotNull(), "renamed").when(F.col("copy_from").isNotNull(), "copied").otherwise("modified").alias("status"),
        F.when(made, zero(part(1))).otherwise(part(1)).alias("old_blob"), F.when(gone & ~made, zero(part(2))).otherwise(part(2)).alias("new_blob"),
        F.coalesce(rest("deleted"), rest("old_mode"), part(3)).alias("old_mode"), F.coalesce(rest("added"), rest("new_mode"), part(3)).alias("new_mode"),
        rest("similarity").alias("similarity"), "binary",
        F.when(F.col("index").isNotNull() & ~F.col("index").rlike(INDEX), display(F.col("index")))
        .when(F.greatest(*[F.col(k).isNotNull() & plain(k).isNull() for k in paths]), F.lit("quoted path")).alias("malformed"),
    )
    told = fenced(told)
    told = fenced(told.withColumns({c: normal_path(display(F.col(f"{c}_raw"))) for c in ("old", "new")}))
    path = lambda c: F.col(c.removesuffix("_raw"))
    status = F.when(F.col("old_raw").isNull() & ~F.col("made"), "added").when(F.col("new_raw").isNull() & ~F.col("gone"), "deleted").otherwise(F.col("status"))
    return told.select(*own, path("old_raw").alias("old_path"), path("new_raw").alias("new_path"), status.alias("status"), "old_blob", "new_blob", "old_mode", "new_mode", "similarity", "binary", F.coalesce("malformed", F.when((F.col("old_raw").isNotNull() & path("old_raw").isNull()) | (F.col("new_raw").isNotNull() & path("new_raw").isNull()), F.lit("unsafe path"))).alias("malformed"))


def raw_hunks(records_: DataFrame, *kept: str) -> DataFrame:
    """key, rec, the kept columns, hunk_no, raw of each hunk, dealt by hunk."""
    parts = F.split("raw", "(?<=\n)(?=@@ )")
    return records_.where("rec > 0").select("key", "rec", *kept, F.posexplode(parts).alias("p", "raw")).select("key", "rec", *kept, F.col("p").cast("long").alias("hunk_no"), "raw").where("hunk_no > 0").repartition("key", "rec", "hunk_no")


def hunk_heads(raw: DataFrame, *kept: str) -> DataFrame:
    """The kept columns, ranges and heading of hunks; a missing count is 1; ranges are null where the header breaks its form."""
    head = F.regexp_replace(F.split("raw", "\n", 2)[0], r"\r\z", "")
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(head, '{HUNK.replace(chr(92), chr(92) * 2)}', {i}), '') AS LONG)")
    rows = raw.withColumn("head", head)
    return rows.select("key", "rec", *kept, "hunk_no", part(1).alias("old_start"), F.coalesce(part(2), F.lit(1)).alias("old_count"), part(3).alias("new_start"), F.coalesce(part(4), F.lit(1)).alias("new_count"), F.trim(display(F.regexp_extract("head", HUNK, 5))).alias("heading"), F.length("raw").cast("long").alias("raw_patch_bytes"), F.sha2(raw_bytes(F.col("raw")), 256).alias("patch_hash"), display(F.col("head")).alias("head"))


def hunk_rows(raw: DataFrame) -> DataFrame:
    """The lines of hunks: key, rec, hunk_no, pos, mark, content (one character a byte), no_newline (the marker follows), error."""
    text = F.split(_trimmed(F.col("raw")), "\n")
    rows = raw.select("key", "rec", "hunk_no", F.posexplode(text).alias("pos", "line")).where("pos > 0")
    note = f"regexp_replace(line, '\\\\r\\\\z', '') = '{MARKER.replace(chr(92), chr(92) * 2)}'"
    order = "OVER (PARTITION BY key, rec, hunk_no ORDER BY pos)"
    told = rows.selectExpr("*", f"{note} AS is_note", "substr(line, 1, 1) AS mark")
    near = told.selectExpr("*", f"coalesce(lead(is_note) {order}, false) AS no_newline", f"lag(mark) {order} AS before", f"lag(is_note) {order} AS twice")
    error = "CASE WHEN is_note AND (before IS NULL OR twice) THEN 'orphan marker' WHEN is_note THEN NULL WHEN line = '' THEN 'empty line' WHEN mark NOT IN (' ', '-', '+') THEN 'unexpected line' END"
    return near.selectExpr("key", "rec", "hunk_no", "CAST(pos AS LONG) AS pos", "mark", "substr(line, 2) AS content", "no_newline", "is_note", f"{error} AS error")


def hunk_files(raw: DataFrame, heads: DataFrame) -> DataFrame:
    """Hunk rows as the ledger takes them, but with key and rec for the file: ranges, patch_hash and rows, the lines with coordinates and blocks."""
    rows = hunk_rows(raw).where("NOT is_note AND mark IN (' ', '-', '+')")
    at = "OVER (PARTITION BY key, rec, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"
    block = rows.selectExpr("*", f"sum(IF(mark = ' ', 1L, 0L)) {at.format('CURRENT ROW')} AS block", f"sum(IF(mark <> '+', 1L, 0L)) {at.format('1 PRECEDING')} AS o", f"sum(IF(mark <> '-', 1L, 0L)) {at.format('1 PRECEDING')} AS n")
    line = F.struct("pos", F.expr("CASE mark WHEN ' ' THEN 'keep' WHEN '-' THEN 'before' ELSE 'after' END AS kind"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("n", F.lit(0)).alias("n"), "block", display(F.col("content")).alias("content"), F.sha2(raw_bytes(F.col("content")), 256).alias("content_hash"), (~well_formed(F.col("content"))).alias("undecodable"), "no_newline")
    each = block.groupBy("key", "rec", "hunk_no").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return heads.join(each, ["key", "rec", "hunk_no"])


def parsed_lines(raw: DataFrame, *kept: str) -> DataFrame:
    """Changed lines of raw_hunks with the kept columns, as parse_lines; the lines of a hunk are numbered in one pass over them."""
    heads = hunk_heads(raw, *kept, "raw").select("key", "rec", *kept, "hunk_no", "old_start", "new_start", F.split(_trimmed(F.col("raw")), "\n").alias("text"))
    rows = heads.select("key", "rec", *kept, "hunk_no", "old_start", "new_start", F.posexplode("text").alias("pos", "line")).where("pos > 0")
    note = f"regexp_replace(line, '\\\\r\\\\z', '') = '{MARKER.replace(chr(92), chr(92) * 2)}'"
    order = "OVER (PARTITION BY key, rec, hunk_no ORDER BY pos {0})"
    before, upto = (order.format(f"ROWS BETWEEN UNBOUNDED PRECEDING AND {x}") for x in ("1 PRECEDING", "CURRENT ROW"))
    count = lambda marks, at, name: f"coalesce(sum(IF(mark IN ({marks}) AND NOT is_note, 1L, 0L)) {at}, 0L) AS {name}"
    marked = rows.selectExpr("*", f"{note} AS is_note", "substr(line, 1, 1) AS mark")
    told = marked.selectExpr("*", f"coalesce(lead(is_note) {order.format('')}, false) AS no_newline", count("' '", upto, "block"), count("' ', '-'", before, "o"), count("' ', '+'", before, "n"), count("'-', '+'", before, "ordinal"))
    content = F.substring("line", F.lit(2), F.length("line"))
    changed = told.where("NOT is_note AND mark IN ('-', '+')")
    return changed.select("key", "rec", *kept, "hunk_no", "ordinal", F.when(F.col("mark") == "-", "before").otherwise("after").alias("side"), F.when(F.col("mark") == "-", F.col("old_start") + F.col("o")).otherwise(F.col("new_start") + F.col("n")).alias("line"), "block", display(content).alias("content"), F.sha2(raw_bytes(content), 256).alias("content_hash"), "no_newline", (~well_formed(content)).alias("undecodable"))


def parse_lines(hunks: DataFrame) -> DataFrame:
    """Changed lines of hunk_files: key, rec, hunk_no, side, line, block, ordinal, content, content_hash, no_newline, undecodable."""
    only = F.filter("rows", lambda x: x["kind"] != "keep")
    rows = hunks.select("key", "rec", "hunk_no", "old_start", "new_start", F.posexplode(only).alias("ordinal", "x"))
    return rows.selectExpr("key", "rec", "hunk_no", "CAST(ordinal AS LONG) AS ordinal", "x.kind AS side", "IF(x.kind = 'before', old_start + x.o, new_start + x.n) AS line", "x.block", "x.content", "x.content_hash", "x.no_newline", "x.undecodable")


class Patch:
    """What is read from patches (key, text): files, hunks, lines and errors."""

    def __init__(self, patches: DataFrame, key: str = "path", text: str = "patch"):
        self._read(records(patches, key, text))

    @classmethod
    def of(cls, records_: DataFrame) -> Patch:
        """What is read from records (key, rec, raw), such as those of sources.patch_files."""
        out = cls.__new__(cls)
        out._read(records_)
        return out

    def _read(self, records_: DataFrame) -> None:
        self.records = records_
        self.files = headers(self.records)
        self.raw = raw_hunks(self.records)
        self.heads = hunk_heads(self.raw)
        self.hunks = hunk_files(self.raw, self.heads)
        self.lines = parse_lines(self.hunks)

    @property
    def text_lines(self) -> DataFrame:
        """Changed lines with their file's paths; those of nested repositories are left out. Headers are read where their hunks are, so no join is needed."""
        nested = f"coalesce(old_mode, '') = '{SUBMODULE}' OR coalesce(new_mode, '') = '{SUBMODULE}'"
        read = headers(self.records, "raw").where(f"NOT ({nested})").select("key", "rec", "old_path", "new_path", "raw")
        return parsed_lines(raw_hunks(read, "old_path", "new_path"), "old_path", "new_path")

    @property
    def totals(self) -> DataFrame:
        """Per hunk the declared and the found numbers of lines of both sides."""
        found = lambda other: F.size(F.filter("rows", lambda x: x["kind"] != other)).cast("long")
        return self.hunks.where("old_start IS NOT NULL").select("key", "rec", "hunk_no", F.col("old_count").alias("old_declared"), found("after").alias("old_found"), F.col("new_count").alias("new_declared"), found("before").alias("new_found"))

    @property
    def errors(self) -> DataFrame:
        """key, rec, hunk_no (0 for a record's own), error: everything that makes a patch unfit."""
        of = lambda df, where, error, hunk="0L": df.where(where).selectExpr("key", "rec", f"{hunk} AS hunk_no", f"{error} AS error")
        parts = [
            of(self.records, "rec = 0 AND trim(BOTH ' \\t\\r\\n' FROM raw) <> ''", "'data before the first record'"),
            of(self.files, "malformed IS NOT NULL", "IF(malformed IN ('quoted path', 'unsafe path'), malformed, 'malformed index line')"),
            of(self.files, "status = 'added' AND new_path IS NULL OR status = 'deleted' AND old_path IS NULL", "'no path'"),
            of(self.heads, "old_start IS NULL", "'malformed hunk header'", "hunk_no"),
            of(hunk_rows(self.raw), "error IS NOT NULL", "error", "hunk_no"),
            of(self.totals, "old_declared <> old_found OR new_declared <> new_found", "'totals differ from the header'", "hunk_no"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()


def parse_patch(patches: DataFrame, key: str = "path", text: str = "patch") -> DataFrame:
    """Changed lines of patches: key, path (after, or before for a deleted file), side, line, hunk_no, ordinal, content, content_hash, no_newline, undecodable."""
    return Patch(patches, key, text).text_lines.selectExpr("key", "coalesce(new_path, old_path) AS path", "side", "line", "hunk_no", "ordinal", "block", "content", "content_hash", "no_newline", "undecodable")


def checked_patch(patches: DataFrame, key: str = "path", text: str = "patch") -> Patch:
    """As Patch, but raises ValueError if a patch is unfit; at most ten errors are named."""
    found = Patch(patches, key, text)
    if bad := found.errors.limit(10).collect():
        raise ValueError("; ".join(f"{r['key']} record {r.rec} hunk {r.hunk_no}: {r.error}" for r in bad))
    return found
