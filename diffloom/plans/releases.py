"""Queries over scopes, snapshots, release artifacts and benchmark results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import normal_path
from ..functions.markers import requirements
from ..functions.text import canonical_json
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import release as X
from ..operators import scopes as O
from ..sources import snapshot as N
from .base import BASE, quote
from .explains import choose, pick

LICENSE_TEXTS = {"MIT": "Permission is hereby granted, free of charge, to any person", "BSD-3-Clause": "Redistribution and use in source and binary forms. Neither the name nor the names of its\ncontributors may be used to endorse or promote products", "Unlicense": "This is free and unencumbered software released into the public domain.", "": "", "?": "All rights reserved."}
NAMES = ["LICENSE", "COPYING.txt", "NOTICE", "licenses/apache.txt", "src/main.py", "docs/license_notes.md", "authors.rst", "Licence-MIT"]
MATERIAL = ["license", "copying", "notice", "license", None, "license", "license", "license"]


def _files(x):
    return x.table("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation")


def _remotes(x):
    """Addresses of pages as remotes in four forms: as they are, scp-like, bare, and with an ending."""
    parts = x.table("pages").selectExpr("page_id AS id", "url", "regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host", "regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS rest")
    form = F.expr("CASE CAST(id % 4 AS INT) WHEN 0 THEN url WHEN 1 THEN concat('git@', host, ':', rest, '.git') WHEN 2 THEN concat(host, '/', rest, '/') ELSE concat(url, '.git//') END")
    return parts.select("id", O.remote_repository(form).alias("repository"), O.canonical_remote(form).alias("canonical"))


def _paths(x):
    """Paths of pages' addresses, some absolute, dotted, leading out, or of files that hold credentials."""
    rest = "regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)"
    path = F.expr(f"CASE CAST(page_id % 9 AS INT) WHEN 0 THEN {rest} WHEN 1 THEN concat('./', {rest}, '//x.py') WHEN 2 THEN concat('/', {rest}) WHEN 3 THEN concat('../', {rest}) WHEN 4 THEN concat({rest}, '/.ENV') WHEN 5 THEN concat('a/../', {rest}) WHEN 6 THEN concat({rest}, '/.git/config') WHEN 7 THEN concat({rest}, '.PEM') ELSE concat('.', '/', '.') END")
    return x.table("pages").select(F.col("page_id").alias("id"), path.alias("path")).select("id", normal_path("path").alias("normal"), N.safe_path("path").alias("safe"))


def _commits(x):
    """Commits named by part: parents are half of it, and three before every fifth; every 50th and those below 2 have none."""
    part = x.table("part").where("p_partkey % 50 <> 0")
    ids = "filter(array(IF(p_partkey div 2 >= 1 AND (p_partkey div 2) % 50 <> 0 AND p_partkey > 1, concat('c', p_partkey div 2), NULL), IF(p_partkey >= 10 AND p_partkey % 5 = 0 AND (p_partkey - 3) % 50 <> 0, concat('c', p_partkey - 3), NULL)), p -> p IS NOT NULL)"
    return part.selectExpr("concat('c', p_partkey) AS sha", f"{ids} AS parents")


def _scopes(x):
    """Scopes by customer, some of which ask for two things or something that there isn't."""
    s = lambda k, e: f"IF(id % 13 = {k}, {e}, NULL)"
    c = "concat('c', id)"
    return _files(x).selectExpr("id", "id % 13 IN (0, 9) AS staged", "id % 13 IN (1, 9) AS unstaged", f"CASE WHEN id % 13 IN (2, 3, 10) THEN {c} WHEN id % 13 = 11 THEN 'c_none' END AS commit", f"CASE id % 13 WHEN 4 THEN concat({c}, '..c9') WHEN 5 THEN concat({c}, '...c9') WHEN 12 THEN 'c1..' END AS range", s(6, c) + " AS branch", "CASE id % 13 WHEN 7 THEN id % 5 END AS pr", "CASE id % 13 WHEN 3 THEN id % 3 WHEN 8 THEN 1 WHEN 10 THEN 9 END AS parent")


def _resolved(x):
    refs = x.spark.sql("SELECT 'HEAD' AS name, 'c7' AS sha")
    requests = x.spark.range(1, 4).selectExpr("id AS number", "'c9' AS base", "concat('c', id * 20) AS head")
    return O.resolved(x.spark, _scopes(x), refs, _commits(x), requests)


def _fingerprints(x):
    """Fingerprints before and after; every 9th changes, every 10th is gone."""
    before = _files(x).selectExpr("id", "element_at(array('staged', 'unstaged', 'working', 'commit'), CAST(id % 4 AS INT) + 1) AS mode", "sha2(name, 256) AS fingerprint")
    after = before.where("id % 10 <> 3").withColumn("fingerprint", F.expr("IF(id % 9 = 2, 'x', fingerprint)"))
    return O.changed_meanwhile(before, after)


def _comparisons(x):
    c = lambda e: F.expr(e)
    rows = _files(x).select("id", F.lit("/local").alias("repository_root"), N.repository_id(c("concat('/store/', nation)"), c("IF(id % 3 = 0, NULL, name)")).alias("repository_id"), O.comparison_id(c("name"), c("segment"), c("IF(id % 2 = 0, NULL, 'b')"), c("'t'"), c("'bt'"), c("'ht'"), c("IF(id % 5 = 0, 1, NULL)")).alias("identity"), N.snapshot_key(F.lit("before"), c("segment"), c("name")).alias("snapshot_key"))
    return O.portable(rows)


def _index(x):
    return N.unmerged(x.table("lineitem").selectExpr("concat('p', l_orderkey) AS path", "l_linenumber % 4 AS stage"))


def _snapshot(x):
    """The after side as a snapshot: every 11th file is a nested repository, every 13th stands twice, every 17th is a link."""
    mode = "CASE WHEN doc_id % 11 = 4 THEN '160000' WHEN doc_id % 17 = 6 THEN '120000' ELSE new_mode END"
    rows = x.files.where("new_path IS NOT NULL").selectExpr("'after' AS side", "new_path AS path", f"{mode} AS mode", "new_blob AS object", "text AS content", "doc_id")
    return rows.unionByName(rows.where("doc_id % 13 = 5")).drop("doc_id")


def _lookup(x):
    wanted = x.files.selectExpr("'after' AS side", "IF(doc_id % 7 = 1, concat(path, '.gone'), path) AS path")
    return N.source_of(wanted, _snapshot(x)).select("side", "path", F.sha2("content", 256).alias("content_hash"))


def _materialised(x):
    named = _snapshot(x).withColumn("path", F.expr("IF(path LIKE '%.csv', concat(path, '/.env'), IF(path LIKE '%.bin', concat('/', path), path))"))
    return N.materialised(named).select("path", "mode", F.sha2("content", 256).alias("content_hash"), F.length(N.normalised(F.concat("content", F.lit("\r\n")))).cast("long").alias("n_chars"))


def _licenses(x):
    """License texts by supplier, and the expression that each is expected to have."""
    s = x.table("supplier")
    keys = list(LICENSE_TEXTS)
    text = "CASE CAST({0} % 5 AS INT) " + " ".join(f"WHEN {k} THEN {quote(v).replace(chr(10), chr(92) + 'n')}" for k, v in enumerate(LICENSE_TEXTS.values())) + " END"
    expected = s.selectExpr("s_suppkey AS id", f"{pick('s_suppkey', ['MIT OR  Unlicense', 'MIT AND BSD-3-Clause', 'BSD-3-Clause', 'Unlicense', 'MIT', 'MIT OR Unlicense'])} AS expression")
    texts = s.selectExpr("s_suppkey AS id", "'LICENSE' AS path", f"{text.format('s_suppkey')} AS content").unionByName(s.where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS id", "'LICENSE-2' AS path", f"{text.format('s_suppkey div 2')} AS content"))
    assert keys[0] == "MIT"
    return X.license_errors(expected, texts)


def _markdown_files(x):
    """A Markdown file of each page in one of five folders, with repeated headings and links to other pages' files: up and down, with titles, to the root, out of it, and some in code."""
    return x.table("pages").selectExpr(
        "concat('d', page_id % 5, '/p', page_id, '.md') AS path",
        """concat('# Page ', page_id, '\n\nSee [next](../d', (page_id + 1) % 5, '/p', page_id + 1, '.md#page-', IF(page_id % 3 = 0, 'none', CAST(page_id + 1 AS STRING)), ') and [own](#notes-', IF(page_id % 4 = 0, 'x', 'a'), ') and [web](https://x.example/a#b)\n',
        '[same](./p', page_id + 5, '.md "the same folder") [root](/d', page_id % 5, '/p', page_id, '.md) [out](../', IF(page_id % 7 = 0, '../', ''), 'd0/p0.md) [second](#notes-a-', page_id % 3, ')\n`[code](none.md)`\n```\n[block](none.md)\n# Notes: A\n```\n## Notes: A\n\n## Notes: A\n') AS text""",
    )


def _artifacts(x):
    """JSON artifacts of pages with nested strings, some of them private or changing."""
    body = F.to_json(F.struct(F.struct("url", F.lit("2024").alias("started_at_utc"), F.col("page_id").cast("string").alias("run_seconds")).alias("page"), F.array(F.concat(F.lit("/home/user"), F.col("page_id") % 7, F.lit("/x")), F.lit("C:\\Users\\me"), F.lit("plain")).alias("notes"), F.array(F.struct(F.lit("file:///tmp/x").alias("at"), F.concat(F.lit("/root/"), "page_id").alias("pid_path"))).alias("list"), F.lit("host1").alias("hostname"), F.col("page_id").alias("n")))
    return x.table("pages").select("page_id", body.alias("body"))


def _leaves(x):
    return X.leaves(_artifacts(x), "page_id", "body")


def _semantic(x):
    """Cold and warm artifacts have one hash: they differ in what changes from run to run, and in every 9th page also elsewhere."""
    cold = _artifacts(x)
    warm = cold.withColumn("body", F.replace("body", F.lit('"2024"'), F.lit('"2025"'))).withColumn("body", F.expr("IF(page_id % 9 = 2, replace(body, 'plain', 'other'), body)"))
    one = lambda df, name: X.semantic_hash(X.semantic_leaves(X.leaves(df, "page_id", "body"), F.lit("/root")), "page_id").withColumnRenamed("hash", name)
    return one(cold, "cold").join(one(warm, "warm"), "page_id").select("page_id", (F.col("cold") == F.col("warm")).alias("equal"))


def _inventory(x):
    """Files of packages, declared and found."""
    own = x.table("part").selectExpr("p_size AS id", "concat(IF(p_partkey % 31 = 4, '../', ''), 'f', p_partkey) AS path", "sha2(p_name, 256) AS hash", "p_partkey")
    declared = own.where("p_partkey % 11 <> 3").unionByName(own.where("p_partkey % 13 = 5"))
    actual = own.where("p_partkey % 17 <> 2").withColumn("hash", F.expr("IF(p_partkey % 19 = 6, 'x', hash)"))
    return X.inventory_errors(declared.drop("p_partkey"), actual.drop("p_partkey"))


def _code_manifest(x):
    a = x.table("lineitem").selectExpr("l_orderkey AS k", "l_shipmode AS m") if "l_shipmode" in x.table("lineitem").columns else x.table("lineitem").selectExpr("l_orderkey AS k", "l_returnflag AS m")
    return X.multiset_difference(a, a.where("k % 23 <> 4").unionByName(a.where("k % 29 = 3")), ["k", "m"])


def _publish(x):
    """Benchmark results of scenarios named by supplier."""
    s = x.table("supplier").selectExpr("s_suppkey AS id")
    row = s.select("id", F.explode(F.array(F.lit("cold"), F.lit("warm"))).alias("label")).where("NOT (id % 10 = 3 AND label = 'warm') AND id % 17 <> 5")
    results = row.selectExpr("id", "label", "IF(id % 7 = 1, 2, 0) AS cache_before", "IF(id % 9 = 4, 'unavailable', 'available') AS graph", "IF(id % 8 = 6, 1, 0) AS failed", "IF(id % 11 = 7, 1, 0) AS skipped", "IF(id % 12 = 5, label, 'i') AS identity", "IF(id % 13 = 8, label, 'h') AS hash")
    return X.publishable(results.unionByName(x.spark.sql("SELECT -1L AS id, explode(array('cold', 'warm')) AS label, 0 AS cache_before, 'available' AS graph, 0 AS failed, 0 AS skipped, 'i' AS identity, 'h' AS hash")), s)


def _times(x):
    """Dates of orders as texts: with zones, without one, as seconds, and none at all."""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    text = f"CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN concat({day}, 'T23:59:59Z') WHEN 1 THEN concat({day}, 'T01:02:03+02:00') WHEN 2 THEN concat({day}, ' 22:00:00-0330') WHEN 3 THEN CAST(o_orderkey * 100003 AS STRING) WHEN 4 THEN concat({day}, 'T23:59:59') ELSE concat('on ', {day}) END"
    return x.table("orders").select(F.col("o_orderkey").alias("id"), X.utc(F.expr(text)).alias("utc"))


#: An environment, and markers by part, all but the last of which hold in it.
ENVIRONMENT = {"python_version": "3.11", "sys_platform": "linux", "os_name": "posix", "platform_machine": "x86_64"}
MARKERS = ["", "; python_version >= '3.9' and sys_platform != 'win32'", "; (os_name == 'nt' or platform_machine in 'x86_64 arm64') and python_version ~= '3.2'", "; python_version < '3.9' or extra == 'old'"]


def _requirements(x):
    """Requirements of parts as texts with bounds and markers: of half of its number, and now and then of a package that isn't known."""
    part = x.table("part").where("p_partkey >= 2")
    own = part.selectExpr("concat('Pkg_', p_partkey) AS name", f"concat('pkg.', p_partkey div 2, ' (>=', p_partkey % 3, ',<', p_partkey, ')', {pick('p_partkey', MARKERS)}) AS requirement")
    other = part.selectExpr("concat('pkg-', p_partkey) AS name", "concat('extern-', p_partkey, '[x] ', IF(p_partkey % 50 = 7, '', '; os_name == \\'nt\\' and python_version > \\'3\\'')) AS requirement")
    return requirements(own.unionByName(other), ENVIRONMENT).select("name", "requires", "active")


def _packages(x):
    return x.table("part").selectExpr("concat('PKG.', p_partkey) AS name", "p_brand AS version", "p_type AS license", "sha2(p_name, 256) AS hash", "p_partkey")


def _edges(x):
    return X.dependency_edges(_requirements(x), _packages(x))


def _unreachable(x):
    """Packages that the last one doesn't need, of the links that lead to known packages."""
    known = _edges(x).where("known").select("node", "parent")
    top = x.table("part").selectExpr("concat('pkg-', max(p_partkey)) AS root").first().root
    return X.unreachable(known, top, _packages(x))


def _reports(x):
    body = "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('{\"archive_info\":{\"hashes\":{\"sha256\":\"', sha2(p_name, 256), '\"}}}') WHEN 1 THEN concat('{\"archive_info\":{\"hash\":\"sha256=', sha2(p_name, 256), '\"}}') WHEN 2 THEN '{\"archive_info\":{\"hash\":\"md5=1\"}}' ELSE '{}' END"
    return x.table("part").selectExpr("p_partkey", f"{body} AS report").select("p_partkey", X.artifact_hash(F.col("report")).alias("hash"))


def _materials(x):
    return X.license_materials(x.table("part").selectExpr("p_partkey AS id", f"{pick('p_partkey', NAMES)} AS path", "p_name AS content"))


def _order(x):
    """Each file with the one before it in order, within its first letter."""
    rows = L.files_in_order(x.files)
    return rows.selectExpr("path", "lag(path) OVER (PARTITION BY substr(at, 1, 1) ORDER BY at, status) AS before")


def _diagnostics(x):
    """Diagnostics in order of their JSON, per code."""
    row = F.struct(F.expr(pick("id", ["a", "b", "c"])).alias("code"), F.col("name").alias("message"), F.expr("IF(id % 2 = 0, 'before', 'after')").alias("side"))
    return _files(x).select("id", F.expr(pick("id", ["a", "b", "c"])).alias("code"), canonical_json(row).alias("json")).selectExpr("id", "code", "CAST(row_number() OVER (PARTITION BY code ORDER BY json) AS LONG) AS place")


def _requests(x):
    """Requests with planted faults, by customer."""
    paths = "CASE CAST(id % 4 AS INT) WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('b', 'a') WHEN 2 THEN array('a', 'a', 'b') ELSE array('a', '../b') END"
    lines = "CASE CAST(id % 5 AS INT) WHEN 0 THEN map('a', array(1, 2)) WHEN 1 THEN map('a', array(2, 1)) WHEN 2 THEN map('a', array(0, 1)) WHEN 3 THEN map('z', array(1)) ELSE map('a', array(3, 3)) END"
    return G.request_errors(_files(x).selectExpr("id", "element_at(array('before', 'after', 'both'), CAST(id % 3 AS INT) + 1) AS side", f"{paths} AS paths", f"{lines} AS lines"))


def _implementation(x):
    rows = x.files.select("path", F.sha2("text", 256).alias("hash"))
    return X.under(rows, ["src1/", "src2/src/", "none"])


def _acquired(x):
    """Pinned inputs by source: every 5th has another number of rows, every 7th other content, every 9th is missing."""
    per = x.files.groupBy("source").agg(F.count("*").alias("n_rows"), F.max("doc_id").alias("m")).select(F.coalesce("source", F.lit("none")).alias("id"), "n_rows", F.col("m").cast("string").alias("hash"), "m")
    found = per.where("m % 9 <> 2").selectExpr("id", "IF(m % 5 = 1, n_rows + 1, n_rows) AS n_rows", "IF(m % 7 = 3, 'x', hash) AS hash")
    return X.acquisition_errors(per.drop("m"), found)


BUILD = {
    "files_order": _order,
    "diagnostics_order": _diagnostics,
    "request_errors": _requests,
    "implementation_files": _implementation,
    "acquired_inputs": _acquired,
    "remote_urls": _remotes,
    "safe_paths": _paths,
    "scope_errors": lambda x: O.scope_errors(_scopes(x)),
    "resolve_scopes": _resolved,
    "changed_meanwhile": _fingerprints,
    "comparison_ids": _comparisons,
    "unmerged_index": _index,
    "source_lookup": _lookup,
    "materialise_snapshot": _materialised,
    "license_set_equality": _licenses,
    "link_check": lambda x: X.link_errors(_markdown_files(x)),
    "privacy_scan": lambda x: X.private_strings(_leaves(x)).select("page_id", "path", "kind"),
    "json_leaves": lambda x: X.leaves(_artifacts(x), "page_id", "body", True).select("page_id", "path", F.array_join("names", ".").alias("names"), "value"),
    "cold_warm_equal": _semantic,
    "package_inventory": _inventory,
    "code_manifest": _code_manifest,
    "publish_gate": _publish,
    "utc_times": _times,
    "sbom_edges": _edges,
    "sbom_unreachable": _unreachable,
    "sbom_components": lambda x: X.components(_packages(x)),
    "artifact_hashes": _reports,
    "license_materials": _materials,
}

_f = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer"
_bools = lambda by, xs: f"CASE CAST(({by}) % {len(xs)} AS INTEGER) " + " ".join(f"WHEN {k} THEN {str(v).lower()}" for k, v in enumerate(xs)) + " END"
_commits_sql = "cm0 AS (SELECT p_partkey AS p, 'c' || p_partkey AS sha FROM part WHERE p_partkey % 50 <> 0), cm AS (SELECT sha, list_filter([CASE WHEN p // 2 >= 1 AND (p // 2) % 50 <> 0 AND p > 1 THEN 'c' || p // 2 END, CASE WHEN p >= 10 AND p % 5 = 0 AND (p - 3) % 50 <> 0 THEN 'c' || (p - 3) END], lambda x: x IS NOT NULL) AS parents FROM cm0)"
_c = "'c' || id"
_scopes_sql = f"sc AS (SELECT id, id % 13 AS r, CASE id % 13 WHEN 4 THEN {_c} WHEN 5 THEN {_c} WHEN 7 THEN CASE WHEN id % 5 BETWEEN 1 AND 3 THEN 'c9' END WHEN 6 THEN 'HEAD' END AS l0, {_c} AS c, CASE id % 13 WHEN 3 THEN id % 3 WHEN 8 THEN 1 WHEN 10 THEN 9 END AS parent, id % 5 AS pr FROM fi)"
_scope_error = "CASE WHEN r = 9 THEN 'comparison modes exclude each other' WHEN r = 8 THEN 'a parent needs a commit' WHEN r = 3 AND parent < 1 THEN 'a parent is a positive number' WHEN r = 7 AND pr < 1 THEN 'a request is a positive number' WHEN r = 12 THEN 'a range has two ends' END"
_resolve = f"""
sc1 AS (SELECT *, {_scope_error} AS bad, CASE r WHEN 0 THEN 'staged' WHEN 1 THEN 'unstaged' WHEN 2 THEN 'commit' WHEN 3 THEN 'commit' WHEN 10 THEN 'commit' WHEN 11 THEN 'commit' WHEN 4 THEN 'range-..' WHEN 5 THEN 'range-...' WHEN 6 THEN 'branch' WHEN 7 THEN 'pr' ELSE 'working' END AS mode FROM sc),
sc2 AS (SELECT *, CASE WHEN r IN (4, 5) THEN c WHEN r = 7 THEN CASE WHEN pr BETWEEN 1 AND 3 THEN 'c9' END WHEN r <> 1 THEN 'HEAD' END AS ln, CASE WHEN r IN (2, 3, 10) THEN c WHEN r = 11 THEN 'c_none' WHEN r IN (4, 5) THEN 'c9' WHEN r = 6 THEN c WHEN r = 7 THEN CASE WHEN pr BETWEEN 1 AND 3 THEN 'c' || pr * 20 END END AS rn FROM sc1 WHERE bad IS NULL),
nm AS (SELECT sha AS name, sha FROM cm UNION ALL SELECT 'HEAD', 'c7'),
sc3 AS (SELECT s.*, a.sha AS ls, b.sha AS rs, p.parents FROM sc2 s LEFT JOIN nm a ON a.name = ln LEFT JOIN nm b ON b.name = rn LEFT JOIN cm p ON p.sha = b.sha),
e AS (SELECT sha AS node, unnest(parents) AS parent FROM cm),
up(node, ancestor) AS (SELECT sha, sha FROM cm UNION SELECT up.node, e.parent FROM up JOIN e ON up.ancestor = e.node),
pr_ AS (SELECT DISTINCT ls, rs FROM sc3 WHERE mode IN ('range-...', 'branch', 'pr') AND ls IS NOT NULL AND rs IS NOT NULL),
cb AS (SELECT pr_.*, a.ancestor FROM pr_ JOIN up a ON a.node = ls JOIN up b ON b.node = rs AND a.ancestor = b.ancestor),
db AS (SELECT DISTINCT ls, rs, up.ancestor FROM cb JOIN up ON up.node = cb.ancestor AND up.node <> up.ancestor),
mb AS (SELECT ls, rs, count(*) AS n_bases, min(ancestor) AS common FROM cb ANTI JOIN db USING (ls, rs, ancestor) GROUP BY ALL),
sc4 AS (SELECT s.*, coalesce(n_bases, 0) AS nb, common, CASE WHEN mode <> 'unstaged' AND s.ls IS NULL THEN coalesce(ln, 'request') WHEN mode NOT IN ('working', 'staged', 'unstaged') AND s.rs IS NULL THEN coalesce(rn, 'request') END AS lost FROM sc3 s LEFT JOIN mb USING (ls, rs)),
sc5 AS (SELECT *, CASE WHEN lost IS NOT NULL THEN 'unknown revision ' || lost WHEN mode = 'commit' AND len(parents) > 1 AND parent IS NULL THEN 'a merge commit needs a parent' WHEN mode = 'commit' AND CASE WHEN len(parents) = 0 THEN parent IS NOT NULL ELSE coalesce(parent, 1) > len(parents) END THEN 'no such parent' WHEN mode IN ('range-...', 'branch', 'pr') AND nb <> 1 THEN nb || ' merge bases' END AS error,
  CASE WHEN mode IN ('working', 'staged', 'range-..') THEN ls WHEN mode = 'commit' THEN CASE WHEN len(parents) = 0 THEN '{O.EMPTY_TREE}' ELSE parents[coalesce(parent, 1)] END WHEN mode IN ('range-...', 'branch', 'pr') THEN common END AS b, CASE WHEN mode = 'branch' THEN ls ELSE rs END AS t FROM sc4)
SELECT id, mode, CASE WHEN error IS NULL THEN b END AS base, CASE WHEN error IS NULL THEN t END AS target, CASE WHEN error IS NULL THEN CASE WHEN mode IN ('working', 'staged') THEN 'HEAD' WHEN mode = 'unstaged' THEN 'index' WHEN mode = 'branch' THEN 'merge-base(HEAD,' || c || ')' WHEN mode = 'pr' THEN 'merge-base(' || ls || ',' || rs || ')' ELSE b END END AS base_label, CASE WHEN error IS NULL THEN CASE WHEN mode = 'staged' THEN 'index' WHEN mode IN ('working', 'unstaged') THEN 'working-tree' WHEN mode = 'branch' THEN 'HEAD' ELSE t END END AS head_label, error FROM sc5
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, bad FROM sc1 WHERE bad IS NOT NULL"""
_hash = lambda *xs: f"sha256(CAST(to_json([{', '.join(xs)}]) AS VARCHAR))"
_snap = """
sn0 AS (SELECT new_path AS path, CASE WHEN doc_id % 11 = 4 THEN '160000' WHEN doc_id % 17 = 6 THEN '120000' ELSE new_mode END AS mode, text AS content, doc_id FROM files WHERE new_path IS NOT NULL),
sn AS (SELECT * FROM sn0 UNION ALL SELECT * FROM sn0 WHERE doc_id % 13 = 5)"""
_text = lambda by: "CASE CAST(" + by + " % 5 AS INTEGER) " + " ".join(f"WHEN {k} THEN {quote(n)}" for k, n in enumerate(LICENSE_TEXTS)) + " END"
_leaf = """
lf AS (SELECT page_id, unnest([{'path': '$.page.url', 'name': 'url', 'value': url}, {'path': '$.page.started_at_utc', 'name': 'started_at_utc', 'value': '2024'}, {'path': '$.page.run_seconds', 'name': 'run_seconds', 'value': CAST(page_id AS VARCHAR)}, {'path': '$.notes[0]', 'name': 'notes', 'value': '/home/user' || page_id % 7 || '/x'}, {'path': '$.notes[1]', 'name': 'notes', 'value': 'C:\\Users\\me'}, {'path': '$.notes[2]', 'name': 'notes', 'value': 'plain'}, {'path': '$.list[0].at', 'name': 'at', 'value': 'file:///tmp/x'}, {'path': '$.list[0].pid_path', 'name': 'pid_path', 'value': '/root/' || page_id}, {'path': '$.hostname', 'name': 'hostname', 'value': 'host1'}], recursive := true) FROM pages)"""
_own = "ow AS (SELECT p_size AS id, CASE WHEN p_partkey % 31 = 4 THEN '../' ELSE '' END || 'f' || p_partkey AS path, p_partkey AS p FROM part)"

_bad_requests = [
    ("unknown side", "id % 3 = 2"), ("paths not sorted or repeated", "id % 4 IN (1, 2, 3)"), ("unsafe path", "id % 4 = 3"), ("lines not sorted or repeated", "id % 5 IN (1, 4)"), ("line below 1", "id % 5 = 2"), ("lines of no path", "id % 5 = 3"),
]

SQL = {
    "files_order": f"{BASE} SELECT path, lag(path) OVER (PARTITION BY substr(coalesce(new_path, old_path), 1, 1) ORDER BY coalesce(new_path, old_path), status) AS before FROM files",
    "diagnostics_order": f"WITH f AS ({_f}), j AS (SELECT id, {choose('id', ['a', 'b', 'c'])} AS code, name, CASE WHEN id % 2 = 0 THEN 'before' ELSE 'after' END AS side FROM f) SELECT id, code, row_number() OVER (PARTITION BY code ORDER BY CAST(json_object('code', code, 'message', name, 'side', side) AS VARCHAR)) AS place FROM j",
    "request_errors": " UNION ALL ".join(f"SELECT id, {quote(e)} AS error FROM ({_f}) WHERE {c}" for e, c in _bad_requests),
    "implementation_files": f"{BASE} SELECT path, sha256(text) AS hash FROM files WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/src/')",
    "acquired_inputs": f"{BASE}, p AS (SELECT coalesce(source, 'none') AS id, max(doc_id) AS m FROM files GROUP BY source) SELECT id, CASE WHEN m % 9 = 2 THEN 'missing' WHEN m % 5 = 1 THEN 'other number of rows' ELSE 'other content' END AS error FROM p WHERE m % 9 = 2 OR m % 5 = 1 OR m % 7 = 3",
    "remote_urls": """WITH p AS (SELECT page_id AS id, url, string_split(url, '/')[3] AS host, array_to_string(string_split(url, '/')[4:], '/') AS rest FROM pages),
t AS (SELECT *, rtrim(rest, '/') AS r FROM p), q AS (SELECT *, CASE WHEN id % 4 = 3 THEN rest WHEN ends_with(r, '.git') AND id % 4 <> 1 THEN r[1:-5] ELSE CASE WHEN id % 4 = 1 THEN rest ELSE r END END AS own FROM t)
SELECT id, CASE WHEN len(string_split(own, '/')) = 2 AND NOT list_contains(string_split(own, '/'), '') AND host <> '' THEN CASE WHEN id % 4 = 1 THEN host ELSE lower(host) END || '/' || own END AS repository,
  CASE id % 4 WHEN 1 THEN 'git@' || host || ':' || rest WHEN 2 THEN host || '/' || own WHEN 3 THEN url ELSE string_split(url, '/')[1] || '//' || host || CASE WHEN len(string_split(url, '/')) > 3 AND own <> '' THEN '/' || own ELSE '' END END AS canonical FROM q""",
    "safe_paths": f"""WITH p AS (SELECT page_id AS id, regexp_replace(array_to_string(string_split(url, '/')[4:], '/'), '[?#].*$', '') AS rest FROM pages),
q AS (SELECT id, CASE id % 9 WHEN 0 THEN rest WHEN 1 THEN './' || rest || '//x.py' WHEN 2 THEN '/' || rest WHEN 3 THEN '../' || rest WHEN 4 THEN rest || '/.ENV' WHEN 5 THEN 'a/../' || rest WHEN 6 THEN rest || '/.git/config' WHEN 7 THEN rest || '.PEM' ELSE './.' END AS path FROM p),
r AS (SELECT *, string_split(path, '/') AS parts, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS full_ FROM q)
SELECT id, CASE WHEN NOT starts_with(path, '/') AND len(full_) > 0 AND full_[1] <> '..' THEN array_to_string(full_, '/') END AS normal,
  NOT starts_with(path, '/') AND NOT list_has_any(parts, ['..', '.git']) AND lower(parts[-1]) NOT IN ({', '.join(quote(n) for n in N.SENSITIVE_NAMES)}) AND NOT regexp_matches(lower(parts[-1]), '.({'|'.join(x.replace('.', '[.]') for x in N.SENSITIVE_SUFFIXES)})$') AS safe FROM r""",
    "scope_errors": f"WITH fi AS ({_f}), {_scopes_sql}, x AS (SELECT id, {_scope_error} AS error FROM sc) SELECT * FROM x WHERE error IS NOT NULL",
    "resolve_scopes": f"WITH RECURSIVE fi AS ({_f}), {_commits_sql}, {_scopes_sql}, {_resolve}",
    "changed_meanwhile": f"SELECT id, sha256(name) AS before, CASE WHEN id % 10 <> 3 THEN 'x' END AS after FROM ({_f}) WHERE id % 4 <> 3 AND (id % 10 = 3 OR id % 9 = 2)",
    "comparison_ids": f"SELECT id, {_hash(quote('repository/v1'), quote('/store/') + ' || nation', 'CASE WHEN id % 3 = 0 THEN ' + quote('') + ' ELSE name END')} AS repository_id, sha256('comparison/v1' || chr(10) || CAST(to_json([name, segment, CASE WHEN id % 2 <> 0 THEN 'b' END, 't', 'bt', 'ht', CASE WHEN id % 5 = 0 THEN '1' END]) AS VARCHAR)) AS identity, {_hash(quote('snapshot/v1'), quote('before'), 'segment', 'name')} AS snapshot_key FROM ({_f})",
    "unmerged_index": "SELECT 'p' || l_orderkey AS path, l_linenumber % 4 AS stage FROM lineitem WHERE l_linenumber % 4 <> 0",
    "source_lookup": f"{BASE}, {_snap}, o AS (SELECT path, any_value(content) AS content FROM sn WHERE mode <> '160000' GROUP BY path HAVING count(*) = 1) SELECT 'after' AS side, path, sha256(content) AS content_hash FROM (SELECT CASE WHEN doc_id % 7 = 1 THEN path || '.gone' ELSE path END AS path FROM files) LEFT JOIN o USING (path)",
    "materialise_snapshot": f"{BASE}, {_snap} SELECT path, mode, CASE WHEN mode NOT IN ('160000', '120000') THEN sha256(content) END AS content_hash, CASE WHEN mode NOT IN ('160000', '120000') THEN CAST(length(content) + 1 AS BIGINT) END AS n_chars FROM sn WHERE NOT path LIKE '%.csv' AND NOT path LIKE '%.bin'",
    "license_set_equality": f"WITH t AS (SELECT s_suppkey AS id, 'LICENSE' AS path, {_text('s_suppkey')} AS l FROM supplier UNION ALL SELECT s_suppkey, 'LICENSE-2', {_text('(s_suppkey // 2)')} FROM supplier WHERE s_suppkey % 2 = 0), f AS (SELECT DISTINCT id, l AS license FROM t WHERE l NOT IN ('', '?')), e AS (SELECT DISTINCT s_suppkey AS id, trim(unnest(regexp_split_to_array({choose('s_suppkey', ['MIT OR  Unlicense', 'MIT AND BSD-3-Clause', 'BSD-3-Clause', 'Unlicense', 'MIT', 'MIT OR Unlicense'])}, '\\s+(?:OR|AND)\\s+'))) AS license FROM supplier) SELECT id, license, 'not expected' AS error FROM (SELECT * FROM f EXCEPT SELECT * FROM e) UNION ALL SELECT id, license, 'not detected' FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT id, path, CASE WHEN l = '' THEN 'empty' ELSE 'unrecognized' END FROM t WHERE l IN ('', '?')",
    "link_check": """WITH t AS (SELECT 'd' || page_id % 5 || '/p' || page_id || '.md' AS path, page_id,
  unnest([{'target': '../d' || (page_id + 1) % 5 || '/p' || (page_id + 1) || '.md#page-' || CASE WHEN page_id % 3 = 0 THEN 'none' ELSE CAST(page_id + 1 AS VARCHAR) END, 'file': page_id + 1, 'up': false, 'head': page_id % 3 <> 0}, {'target': '#notes-' || CASE WHEN page_id % 4 = 0 THEN 'x' ELSE 'a' END, 'file': page_id, 'up': false, 'head': page_id % 4 <> 0},
  {'target': './p' || (page_id + 5) || '.md', 'file': page_id + 5, 'up': false, 'head': true}, {'target': '/d' || page_id % 5 || '/p' || page_id || '.md', 'file': page_id, 'up': false, 'head': true}, {'target': '../' || CASE WHEN page_id % 7 = 0 THEN '../' ELSE '' END || 'd0/p0.md', 'file': 0, 'up': page_id % 7 = 0, 'head': true}, {'target': '#notes-a-' || page_id % 3, 'file': page_id, 'up': false, 'head': page_id % 3 = 1}]) AS l FROM pages)
SELECT path, l.target AS target, CASE WHEN l.up THEN 'leads out of the root' WHEN l.file NOT IN (SELECT page_id FROM pages) THEN 'no such file' ELSE 'no such heading' END AS error FROM t WHERE l.up OR l.file NOT IN (SELECT page_id FROM pages) OR NOT l.head""",
    "privacy_scan": f"WITH {_leaf} SELECT page_id, path, CASE path WHEN '$.notes[0]' THEN 'home' WHEN '$.notes[1]' THEN 'drive' ELSE 'file' END AS kind FROM lf WHERE path IN ('$.notes[0]', '$.notes[1]', '$.list[0].at')",
    "json_leaves": f"WITH {_leaf}, k AS (SELECT page_id, unnest(['page', 'page.url', 'page.started_at_utc', 'page.run_seconds', 'notes', 'list', 'hostname', 'n']) AS k FROM pages) SELECT page_id, path, regexp_replace(regexp_replace(substr(path, 3), '\\[[0-9]+\\]', '', 'g'), '^', '') AS names, value FROM lf UNION ALL SELECT page_id, '$.' || k || '<key>', k, string_split(k, '.')[-1] FROM k UNION ALL SELECT page_id, '$.list[0].' || x || '<key>', 'list.' || x, x FROM (SELECT page_id, unnest(['at', 'pid_path']) AS x FROM pages)",
    "cold_warm_equal": "SELECT page_id, page_id % 9 <> 2 AS equal FROM pages",
    "package_inventory": f"WITH {_own}, b AS (SELECT *, p % 11 <> 3 OR p % 13 = 5 AS declared, p % 11 <> 3 AND p % 13 = 5 AS twice, p % 17 <> 2 AS found FROM ow) SELECT id, path, CASE WHEN starts_with(path, '../') THEN 'unsafe path' WHEN NOT declared THEN 'not declared' WHEN NOT found THEN 'missing' WHEN twice THEN 'declared twice' ELSE 'other content' END AS error FROM b WHERE (declared OR found) AND (starts_with(path, '../') OR NOT declared OR NOT found OR twice OR p % 19 = 6)",
    "code_manifest": "SELECT l_orderkey AS k, l_returnflag AS m, count(*) AS n_a, count(*) * ((CASE WHEN l_orderkey % 23 <> 4 THEN 1 ELSE 0 END) + (CASE WHEN l_orderkey % 29 = 3 THEN 1 ELSE 0 END)) AS n_b FROM lineitem WHERE l_orderkey % 23 = 4 AND l_orderkey % 29 <> 3 OR l_orderkey % 23 <> 4 AND l_orderkey % 29 = 3 GROUP BY l_orderkey, l_returnflag",
    "publish_gate": "SELECT id, error FROM (SELECT s_suppkey AS id, unnest(list_filter(CASE WHEN s_suppkey % 17 = 5 THEN ['missing'] ELSE [CASE WHEN s_suppkey % 10 = 3 THEN 'other runs than one cold and one warm' END, CASE WHEN s_suppkey % 7 = 1 THEN 'the cold run''s cache isn''t empty' END, CASE WHEN s_suppkey % 9 = 4 THEN 'graph unavailable' END, CASE WHEN s_suppkey % 8 = 6 OR s_suppkey % 11 = 7 THEN 'assertions failed or skipped' END, CASE WHEN s_suppkey % 12 = 5 AND s_suppkey % 10 <> 3 THEN 'runs of several identities' END, CASE WHEN s_suppkey % 13 = 8 AND s_suppkey % 10 <> 3 THEN 'cold and warm output differ' END] END, lambda x: x IS NOT NULL)) AS error FROM supplier) UNION ALL SELECT -1, 'not expected'",
    "utc_times": "SELECT o_orderkey AS id, strftime(CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 86399 SECOND WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3723 SECOND - INTERVAL 2 HOUR WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1530 MINUTE WHEN 3 THEN make_timestamp(o_orderkey * 100003000000) END, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM orders",
    "sbom_edges": "SELECT 'pkg-' || p_partkey AS node, 'pkg-' || p_partkey // 2 AS parent, true AS known FROM part WHERE p_partkey >= 2 AND p_partkey % 4 <> 3 UNION ALL SELECT 'pkg-' || p_partkey, 'extern-' || p_partkey, false FROM part WHERE p_partkey >= 2 AND p_partkey % 50 = 7",
    "sbom_unreachable": "WITH RECURSIVE r(p) AS (SELECT max(p_partkey) FROM part UNION SELECT p // 2 FROM r WHERE p >= 2 AND p % 4 <> 3) SELECT 'pkg-' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT p FROM r)",
    "sbom_components": "SELECT 'pkg:pypi/pkg-' || p_partkey || '@' || p_brand AS ref, CAST(json_object('hashes', [json_object('alg', 'SHA-256', 'content', sha256(p_name))], 'licenses', [json_object('license', json_object('id', p_type))], 'name', 'pkg-' || p_partkey, 'purl', 'pkg:pypi/pkg-' || p_partkey || '@' || p_brand, 'type', 'library', 'version', p_brand) AS VARCHAR) AS component FROM part",
    "artifact_hashes": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN sha256(p_name) END AS hash FROM part",
    "license_materials": f"SELECT p_partkey AS id, {choose('p_partkey', NAMES)} AS path, {choose('p_partkey', MATERIAL)} AS kind, CAST(strlen(p_name) AS BIGINT) AS bytes, sha256(p_name) AS hash FROM part WHERE {choose('p_partkey', MATERIAL)} IS NOT NULL",
}
