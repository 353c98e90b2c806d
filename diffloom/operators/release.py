"""Checks around a release: inventories, licenses, links, private strings, manifests, bills of materials, publication gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .graph import descended

#: Phrases that tell a license, in order; all phrases of a row must occur.
LICENSES = [
    ("Unlicense", ["free and unencumbered software released into the public domain"]),
    ("MIT", ["permission is hereby granted, free of charge"]),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms", "neither the name", "contributors may be used to endorse or promote"]),
]
#: Keys of values that change from run to run, by name and by ending.
VOLATILE_ENDINGS = ("_at_utc", "_duration", "_elapsed", "_seconds")
#: Values of ours: keys whose value names a place or a time; what private strings look like.
VOLATILE = ["started", "finished", "hostname", "pid"]
PRIVATE = [("home", r"(?:^|[^A-Za-z0-9])/(?:home|Users)/[A-Za-z0-9._-]+"), ("drive", r"(?:^|[^A-Za-z])[A-Za-z]:\\Users\\[A-Za-z0-9._-]+"), ("file", r"file://+[A-Za-z0-9._/-]+")]
#: The form of conceptual names.
CONCEPT = r"^conceptual-(hunk|unit):(.+)#([1-9][0-9]*)$"
#: File names that hold license material.
LICENSE_NAMES = r"(?i)^(?:licen[cs]es?|copying|notice|authors|copyright)(?:[._-].*)?$"
#: Levels of nested JSON values that a round opens.
LEVELS = 4


def detected_license(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, phrases in LICENSES:
        all_ = low.contains(phrases[0])
        for p in phrases[1:]:
            all_ = all_ & low.contains(p)
        out = F.when(all_, name) if out is None else out.when(all_, name)
    return out


def license_errors(expected: DataFrame, texts: DataFrame) -> DataFrame:
    """id, license, error where the licenses that the texts (id, path, content) have and those that an expression names (id, expression, joined by OR or AND) aren't the same set; also texts that are empty or of no known license."""
    wanted = expected.select("id", F.explode(F.split("expression", r"\s+(?:OR|AND)\s+")).alias("license")).select("id", F.trim("license").alias("license")).distinct()
    told = texts.withColumn("license", detected_license(F.col("content")))
    found = told.where("license IS NOT NULL").select("id", "license").distinct()
    only = lambda a, b, error: a.join(b, ["id", "license"], "left_anti").withColumn("error", F.lit(error))
    odd = told.where("license IS NULL").select("id", F.col("path").alias("license"), F.when(F.coalesce("content", F.lit("")) == "", "empty").otherwise("unrecognized").alias("error"))
    return only(found, wanted, "not expected").unionByName(only(wanted, found, "not detected")).unionByName(odd)


def leaves(rows: DataFrame, key: str, value: str, keys: bool = False) -> DataFrame:
    """key, path ($.a[0].b), names (the keys on the way), value of every string in JSON values, of any nesting; with keys, the keys of objects too, as path<key>. See json_faults for values that are no JSON; they have no leaves.

    A round takes LEVELS levels as one chain of generators: what is nested is
    replaced by its parts, what isn't stays. Rounds go on with what is still
    nested, so that a plan stays as long as it is.
    """
    spark = rows.sparkSession
    names = "CAST(array() AS array<string>)"
    at = rows.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.expr(names).alias("names"), F.try_parse_json(value).alias("v"), F.lit(False).alias("told")).where("v IS NOT NULL")
    out = None
    while True:
        for _ in range(LEVELS):
            at = _opened(at, keys)
        at = written(spark, at, "json")
        text = at.where("told OR v IS NOT NULL AND NOT nested").select("_key", "path", "names", F.when(F.col("told"), F.element_at("names", -1)).otherwise(F.try_variant_get("v", "$", "string")).alias("value"), (F.col("told") | (F.schema_of_variant("v") == "STRING")).alias("is_text"))
        found = text.where("is_text").drop("is_text").withColumnRenamed("_key", key)
        out = found if out is None else out.unionByName(found)
        at = at.where("NOT told AND nested").drop("nested")
        if at.isEmpty():
            return out


def _opened(at: DataFrame, keys: bool) -> DataFrame:
    """Rows (_key, path, names, v, told) with objects and arrays replaced by their parts, and nested: whether v is one still. A row that is told stands for a key."""
    fields, items = F.try_variant_get("v", "$", "map<string, variant>"), F.try_variant_get("v", "$", "array<variant>")
    row = lambda path, names, v, told: F.struct(path.alias("path"), names.alias("names"), v.alias("v"), told.alias("told"))
    null = F.lit(None).cast("variant")
    of_field = lambda e: row(F.concat("path", F.lit("."), e["key"]), F.array_append("names", e["key"]), e["value"], F.lit(False))
    of_key = lambda e: row(F.concat("path", F.lit("."), e["key"], F.lit("<key>")), F.array_append("names", e["key"]), null, F.lit(True))
    each = F.transform(F.map_entries("_f"), of_field)
    parts = F.when(F.col("told"), F.array(row(F.col("path"), F.col("names"), null, F.lit(True)))).when(F.col("_f").isNotNull(), F.concat(each, F.transform(F.map_entries("_f"), of_key)) if keys else each)
    parts = parts.when(F.col("_i").isNotNull(), F.transform("_i", lambda x, n: row(F.concat("path", F.lit("["), n.cast("string"), F.lit("]")), F.col("names"), x, F.lit(False))))
    parts = parts.otherwise(F.array(row(F.col("path"), F.col("names"), F.col("v"), F.lit(False))))
    opened = at.drop("nested").withColumns({"_f": fields, "_i": items}).select("_key", F.inline(parts))
    return opened.withColumn("nested", F.coalesce(F.schema_of_variant("v").rlike("^(?:OBJECT|ARRAY)"), F.lit(False)))


def json_faults(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, error of values that are no JSON, null ones included."""
    return rows.where(F.try_parse_json(value).isNull()).select(key, F.lit("is no JSON").alias("error"))


def private_strings(found: DataFrame) -> DataFrame:
    """Leaves that name a local place, with the kind of each."""
    kinds = F.filter(F.array(*[F.when(F.col("value").rlike(p), F.lit(k)) for k, p in PRIVATE]), lambda k: k.isNotNull())
    return found.select("*", F.explode(kinds).alias("kind"))


def semantic_leaves(found: DataFrame, root: Column) -> DataFrame:
    """Leaves without what stands under a key that changes from run to run; the local root stands as <root>."""
    changing = lambda k: F.array_contains(F.array(*map(F.lit, VOLATILE)), k) | F.exists(F.array(*map(F.lit, VOLATILE_ENDINGS)), lambda e: k.endswith(e))
    return found.where(~F.exists("names", changing)).withColumn("value", F.replace("value", root, F.lit("<root>")))


def semantic_hash(found: DataFrame, key: str) -> DataFrame:
    """key, hash over all leaves in order of their path."""
    return found.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: F.concat_ws("=", x["path"], x["value"])), "\n"), 256).alias("hash"))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows of one side only, by keys, with side."""
    only = lambda x, y, name: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit(name))
    return only(a, b, names[0]).unionByName(only(b, a, names[1]))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_a, n_b where rows occur unequally often."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(a, "n_a").join(count(b, "n_b"), keys, "full")
    return both.select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).where("n_a <> n_b")


def inventory_errors(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """id, path, error of package files: declared (id, path, hash) and actual (id, path, hash) are to be the same files with the same content, with safe paths, each once."""
    count = declared.groupBy("id", "path").agg(F.count("*").alias("n"), F.min("hash").alias("want"))
    both = count.join(actual.select("id", "path", F.col("hash").alias("have")), ["id", "path"], "full")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..") | F.col("path").contains("\\")
    error = F.when(unsafe, "unsafe path").when(F.col("n").isNull(), "not declared").when(F.col("have").isNull(), "missing").when(F.col("n") > 1, "declared twice").when(F.col("want") != F.col("have"), "other content")
    return both.select("id", "path", error.alias("error")).where("error IS NOT NULL")


def anchor(heading: Column) -> Column:
    """The anchor of a heading: lower case, without punctuation, a hyphen for each run of spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "-")


def resolved_path(path: Column) -> Column:
    """A relative path without . and .. parts; null where it leads out of its root."""
    step = lambda at, p: F.when(at.isNull() | ((p == "..") & (F.size(at) == 0)), F.lit(None)).when(p == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when((p == "") | (p == "."), at).otherwise(F.array_append(at, p))
    return F.aggregate(F.split(path, "/"), F.expr("CAST(array() AS array<string>)"), step, lambda at: F.array_join(at, "/"))


#: Code in Markdown: fenced blocks and spans, in which nothing links.
CODE = r"(?ms)^ {0,3}(```+|~~~+)[^\n]*\n.*?(?:^ {0,3}\1[`~]* *$|\z)|(`+)(?!`)[^\n]*?(?<!`)\2(?!`)"
#: A link's target, bare or in angles, perhaps with a title.
LINK = r"""\[[^\]]*\]\(\s*(?:<([^>\n]*)>|([^)\s]+))(?:\s+(?:"[^"]*"|'[^']*'|\([^)]*\)))?\s*\)"""


def link_errors(documents: DataFrame) -> DataFrame:
    """path, target, error of relative Markdown links in documents (path, text): the file must exist, and the heading that the anchor names.

    Targets are resolved against the document's folder, those that begin with /
    against the root. Repeated headings of a document get -1, -2 and so on.
    Links in code don't count.
    """
    plain = documents.select("path", F.regexp_replace("text", CODE, "").alias("text"), F.regexp_replace("text", CODE.split("|(`+)")[0], "").alias("headed"))
    whole = F.regexp_extract_all("text", F.lit(LINK), F.lit(0))
    part = lambda x: F.concat(F.regexp_extract(x, LINK, 1), F.regexp_extract(x, LINK, 2))
    links = plain.select("path", F.explode(F.array_distinct(F.transform(whole, part))).alias("target")).where(~F.col("target").rlike("(?i)^(?:[a-z][a-z0-9+.-]*:|//)"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    file = F.substring_index("target", "#", 1)
    to = F.when(file == "", F.col("path")).otherwise(resolved_path(F.when(file.startswith("/"), file).otherwise(F.concat(folder, file))))
    placed = links.select("path", "target", to.alias("to"), F.when(F.col("target").contains("#"), F.substring_index("target", "#", -1)).alias("mark"))
    heads = plain.select(F.col("path").alias("to"), F.posexplode(F.regexp_extract_all("headed", F.lit(r"(?m)^ {0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1))).alias("p", "h")).select("to", "p", anchor(F.col("h")).alias("mark"))
    again = heads.selectExpr("to", "mark", "row_number() OVER (PARTITION BY to, mark ORDER BY p) - 1 AS n")
    marks = again.select("to", F.when(F.col("n") > 0, F.concat_ws("-", "mark", "n")).otherwise(F.col("mark")).alias("mark")).distinct().withColumn("marked", F.lit(True))
    known = documents.select(F.col("path").alias("to")).distinct().withColumn("there", F.lit(True))
    rows = placed.join(known, "to", "left").join(marks, ["to", "mark"], "left")
    error = F.when(F.col("to").isNull(), "leads out of the root").when(F.col("there").isNull(), "no such file").when((F.col("mark") != "") & F.col("marked").isNull(), "no such heading")
    return rows.select("path", "target", error.alias("error")).where("error IS NOT NULL")


def concepts(rows: DataFrame, kind: str, id_column: str, order: str) -> DataFrame:
    """concept, evidence_id, path, kind: conceptual names of hunks or units, numbered from 1 within their path."""
    return rows.selectExpr("doc_id", "path", f"{id_column} AS evidence_id", f"concat('conceptual-{kind}:', path, '#', row_number() OVER (PARTITION BY doc_id ORDER BY {order})) AS concept")


def instantiated(template: DataFrame, hunks: DataFrame, units: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners, errors) of a template (concept, owner_id): owners (evidence_id, owner_id) of lines, by their hunk, and of non-text units, by their own concept or else the only owner of their file's hunks.

    Errors: a concept named twice, one that there isn't, a hunk without an
    owner, and a non-text unit whose file has no or several owners.
    """
    named = concepts(hunks, "hunk", "hunk_id", "hunk_no")
    unit = concepts(units, "unit", "unit_id", "unit_no").join(units.select(F.col("unit_id").alias("evidence_id"), "kind"), "evidence_id")
    every = named.select("concept").unionByName(unit.select("concept"))
    once = template.groupBy("concept").agg(F.min("owner_id").alias("owner_id"), F.count("*").alias("n"))
    twice = once.where("n > 1").select("concept", F.lit("named twice").alias("error"))
    lost = once.join(every, "concept", "left_anti").select("concept", F.lit("no such evidence").alias("error"))
    of_hunk = named.join(once.select("concept", "owner_id"), "concept", "left")
    bare = of_hunk.where("owner_id IS NULL").select("concept", F.lit("hunk without owner").alias("error"))
    per_file = of_hunk.groupBy("doc_id").agg(F.count_distinct("owner_id").alias("d"), F.min("owner_id").alias("only"))
    of_unit = unit.where("kind <> 'text'").join(once.select("concept", "owner_id"), "concept", "left").join(per_file, "doc_id", "left").withColumn("owner_id", F.coalesce("owner_id", F.when(F.col("d") == 1, F.col("only"))))
    unowned = of_unit.where("owner_id IS NULL").select("concept", F.lit("unit without an only owner").alias("error"))
    own = lines.select("line_id", "hunk_id").join(of_hunk.select(F.col("evidence_id").alias("hunk_id"), "owner_id"), "hunk_id").where("owner_id IS NOT NULL").select(F.col("line_id").alias("evidence_id"), "owner_id")
    return own.unionByName(of_unit.where("owner_id IS NOT NULL").select("evidence_id", "owner_id")), twice.unionByName(lost).unionByName(bare).unionByName(unowned)


#: Seconds since 1970 that a time of Spark's has at most, a day less, so that no zone's shift leaves its range.
LAST_SECOND = (1 << 63) // 10**6 - 86_400


def utc(value: Column) -> Column:
    """An ISO-8601 time with a zone, or whole seconds since 1970, as UTC with Z; null for others, such as times without a zone and seconds beyond LAST_SECOND. Years after 9999 have their digits, without a sign."""
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})$")
    number = F.when(value.rlike(r"^[0-9]+$"), value.try_cast("long"))
    at = F.coalesce(F.timestamp_seconds(F.when(number <= LAST_SECOND, number)), F.when(zoned, F.try_to_timestamp(F.replace(value, F.lit(" "), F.lit("T")))))
    return F.regexp_replace(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), r"^\+", "")


def canonical_name(name: Column) -> Column:
    """A package name in lower case with single hyphens."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def dependency_edges(requirements: DataFrame, artifacts: DataFrame) -> DataFrame:
    """node, parent (what it requires), known of requirements (name, requires, active): inactive ones, whose marker doesn't hold, are left out."""
    rows = requirements.where("active").select(canonical_name(F.col("name")).alias("node"), canonical_name(F.col("requires")).alias("parent")).distinct()
    named = artifacts.select(canonical_name(F.col("name")).alias("parent")).distinct().withColumn("known", F.lit(True))
    return rows.join(named, "parent", "left").select("node", "parent", F.coalesce("known", F.lit(False)).alias("known"))


def unreachable(edges: DataFrame, root: str, artifacts: DataFrame) -> DataFrame:
    """Artifacts that the root doesn't require, directly or by others, over edges (node, parent)."""
    spark = artifacts.sparkSession
    found = descended(spark, edges, spark.createDataFrame([(root,)], "node string")).select(F.col("node").alias("name"))
    return artifacts.select(canonical_name(F.col("name")).alias("name")).distinct().join(found, "name", "left_anti").where(F.col("name") != root)


def artifact_hash(report: Column) -> Column:
    """The hash that an install report gives, in either of two fields."""
    old = F.regexp_extract(F.get_json_object(report, "$.archive_info.hash"), "^sha256=([0-9a-f]{64})$", 1)
    return F.coalesce(F.get_json_object(report, "$.archive_info.hashes.sha256"), F.nullif(old, F.lit("")))


def components(artifacts: DataFrame) -> DataFrame:
    """ref, component: a JSON document for each artifact (name, version, license, hash)."""
    ref = F.concat(F.lit("pkg:pypi/"), canonical_name(F.col("name")), F.lit("@"), "version")
    body = F.struct(F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("hash").alias("content"))).alias("hashes"), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))).alias("licenses"), canonical_name(F.col("name")).alias("name"), ref.alias("purl"), F.lit("library").alias("type"), F.col("version").alias("version"))
    return artifacts.select(ref.alias("ref"), F.to_json(body).alias("component"))


def license_materials(members: DataFrame) -> DataFrame:
    """id, path, kind, bytes, hash of archive members (id, path, content) whose name or folder says that they hold license text."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.arrays_overlap(F.transform(F.split("path", "/"), F.lower), F.array(F.lit("licenses"), F.lit("license_files")))
    kind = F.when(name.rlike(LICENSE_NAMES) | folder, F.when(F.lower(name).startswith("notice"), "notice").when(F.lower(name).startswith("copying"), "copying").otherwise("license"))
    return members.select("id", "path", kind.alias("kind"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("hash")).where("kind IS NOT NULL")


def publishable(results: DataFrame, expected: DataFrame) -> DataFrame:
    """id, error of benchmark results (id, label, cache_before, graph, failed, skipped, identity, hash) that forbid publication.

    There must be the expected scenarios (id), each with one cold and one warm
    run; the cold one starts with an empty cache; the graph is available, no
    assertion fails or is skipped, and both runs have one identity and hash.
    """
    per = results.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"), F.max(F.when(F.col("label") == "cold", F.col("cache_before"))).alias("cache"), F.bool_and(F.col("graph") == "available").alias("graph"),
        F.sum(F.col("failed") + F.col("skipped")).alias("unmet"), F.count_distinct("identity").alias("identities"), F.count_distinct("hash").alias("hashes"),
    )
    rows = expected.select("id").withColumn("wanted", F.lit(True)).join(per, "id", "full")
    rules = [
        ("not expected", F.col("wanted").isNull()), ("missing", F.col("labels").isNull()), ("other runs than one cold and one warm", F.col("labels") != "cold,warm"), ("the cold run's cache isn't empty", F.col("cache") > 0),
        ("graph unavailable", ~F.col("graph")), ("assertions failed or skipped", F.col("unmet") > 0), ("runs of several identities", F.col("identities") > 1), ("cold and warm output differ", F.col("hashes") > 1),
    ]
    errors = F.filter(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(errors).alias("error"))


def pinned(texts: DataFrame, pins: DataFrame) -> DataFrame:
    """pin, n of pins (pin) that don't stand in the texts (text) exactly once."""
    hits = texts.crossJoin(F.broadcast(pins)).select("pin", ((F.length("text") - F.length(F.replace("text", F.col("pin"), F.lit("")))) / F.length("pin")).cast("long").alias("n"))  # a stated list of pins against all texts
    return hits.groupBy("pin").agg(F.sum("n").alias("n")).where("n <> 1")


def shifted_headings(text: Column) -> Column:
    """Markdown with every heading one level lower."""
    return F.regexp_replace(text, r"(?m)^(#{1,5}) ", "#$1 ")


def under(manifest: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows of a manifest whose path is one of these or lies in one that ends with a slash."""
    good = F.lit(False)
    for p in prefixes:
        good = good | (F.col("path").startswith(p) if p.endswith("/") else F.col("path") == p)
    return manifest.where(good)


def only_row(manifest: DataFrame, path: str):
    """The one row of a path; ValueError if there is none or several."""
    rows = manifest.where(F.col("path") == path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} stands {'several times' if rows else 'nowhere'} in the manifest")
    return rows[0]


def acquisition_errors(expected: DataFrame, found: DataFrame) -> DataFrame:
    """id, error of pinned inputs: expected (id, n_rows, hash) against found (id, n_rows, hash)."""
    rows = expected.join(found.select("id", F.col("n_rows").alias("n"), F.col("hash").alias("h")), "id", "left")
    error = F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("n_rows"), "other number of rows").when(F.col("h") != F.col("hash"), "other content")
    return rows.select("id", error.alias("error")).where("error IS NOT NULL")
