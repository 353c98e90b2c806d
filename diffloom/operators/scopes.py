"""Which two snapshots a comparison is between: scope rules, revisions, merge bases, remotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import merge_bases

#: The id of the empty tree, and the form of object ids.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
OBJECT_ID = "^[0-9a-fA-F]{40,64}$"
MODES = ["staged", "unstaged", "commit", "range", "branch", "pr"]


def remote_repository(url: Column) -> Column:
    """host/owner/name of a remote's address: with a scheme, scp-like, or bare; null for what has no host or another number of parts."""
    url = F.regexp_replace(F.trim(url), r"/+$", "")
    scheme = url.contains("://")
    scp = ~scheme & F.substring_index(url, ":", 1).contains("@") & url.contains(":")
    rest = F.when(scheme, F.substring_index(url, "://", -1)).otherwise(url)
    host = F.when(scp, F.regexp_extract(url, r"^[^:]*@([^:@]+):", 1)).otherwise(F.lower(F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:]+)", 1)))
    path = F.when(scp, F.regexp_extract(url, r"^[^:]*:(.*)$", 1)).otherwise(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(/.*)$", 1), r"^/+", ""))
    path = F.regexp_replace(path, r"\.git$", "")
    return F.when((host != "") & path.rlike("^[^/]+/[^/]+$"), F.concat_ws("/", host, path))


def canonical_remote(url: Column) -> Column:
    """Without slashes and .git at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"\.git$", "")


def scope_errors(scopes: DataFrame) -> DataFrame:
    """id, error of scopes (id, staged, unstaged, commit, range, branch, pr, parent) that ask for several things or an impossible one; the first error counts."""
    n = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") if c in ("staged", "unstaged") else F.col(c).isNotNull().cast("int") for c in MODES), F.lit(0))
    sep = F.when(F.col("range").contains("..."), "\\.\\.\\.").otherwise("\\.\\.")
    ends = F.split("range", sep)
    error = (
        F.when(n > 1, "comparison modes exclude each other")
        .when(F.col("parent").isNotNull() & F.col("commit").isNull(), "a parent needs a commit")
        .when(F.col("parent") < 1, "a parent is a positive number")
        .when(F.col("pr") < 1, "a request is a positive number")
        .when(F.col("range").isNotNull() & ((F.size(ends) != 2) | F.exists(ends, lambda x: x == "")), "a range has two ends")
    )
    return scopes.select("id", error.alias("error")).where("error IS NOT NULL")


def resolved(spark: SparkSession, scopes: DataFrame, refs: DataFrame, commits: DataFrame, requests: DataFrame) -> DataFrame:
    """id, mode, base, target, base_label, head_label, error, one row a scope.

    refs (name, sha) has HEAD; a commit's sha stands for itself. commits (sha,
    parents). requests (number, base, head) stand for a forge's answers. A range
    with three dots, a branch and a request start at the only merge base. A
    merge commit needs a parent's number; a root commit starts at the empty tree.
    """
    bad = scope_errors(scopes)
    names = refs.select("name", "sha").unionByName(commits.select(F.col("sha").alias("name"), "sha"))
    good = scopes.join(bad, "id", "left_anti")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    mode = F.when(flag("staged"), "staged").when(flag("unstaged"), "unstaged").when(F.col("commit").isNotNull(), "commit").when(F.col("range").contains("..."), "range-...").when(F.col("range").isNotNull(), "range-..").when(F.col("branch").isNotNull(), "branch").when(F.col("pr").isNotNull(), "pr").otherwise("working")
    ends = F.split("range", "\\.\\.\\.?")
    asked = good.withColumn("mode", mode).join(requests.select(F.col("number").alias("pr"), F.col("base").alias("pr_base"), F.col("head").alias("pr_head")), "pr", "left")
    left = F.when(F.col("mode").startswith("range"), ends[0]).when(F.col("mode") == "pr", F.col("pr_base")).when(F.col("mode") != "unstaged", F.lit("HEAD"))
    right = F.when(F.col("mode") == "commit", F.col("commit")).when(F.col("mode").startswith("range"), ends[1]).when(F.col("mode") == "branch", F.col("branch")).when(F.col("mode") == "pr", F.col("pr_head"))
    asked = asked.select("id", "mode", "parent", "branch", left.alias("left_name"), right.alias("right_name"))
    of = lambda end: names.select(F.col("name").alias(f"{end}_name"), F.col("sha").alias(f"{end}_sha"))
    found = asked.join(of("left"), "left_name", "left").join(of("right"), "right_name", "left")
    lost = F.when((F.col("mode") != "unstaged") & F.col("left_sha").isNull(), F.coalesce("left_name", F.lit("request"))).when(~F.col("mode").isin("working", "staged", "unstaged") & F.col("right_sha").isNull(), F.coalesce("right_name", F.lit("request")))
    found = found.withColumn("lost", lost).join(commits.select(F.col("sha").alias("right_sha"), "parents"), "right_sha", "left")
    based = F.col("mode").isin("range-...", "branch", "pr")
    pairs = found.where(based & F.col("lost").isNull()).select(F.col("left_sha").alias("left_node"), F.col("right_sha").alias("right_node")).distinct()
    edges = commits.select(F.col("sha").alias("node"), F.explode("parents").alias("parent"))
    bases = merge_bases(spark, edges, pairs).select(F.col("left_node").alias("left_sha"), F.col("right_node").alias("right_sha"), "n_bases", F.col("base").alias("common"))
    rows = found.join(bases, ["left_sha", "right_sha"], "left")
    nth = F.coalesce("parent", F.lit(1)).cast("int")
    own = F.when(F.size("parents") == 0, F.lit(EMPTY_TREE)).otherwise(F.try_element_at("parents", nth))
    base = F.when(F.col("mode").isin("working", "staged"), F.col("left_sha")).when(F.col("mode") == "commit", own).when(F.col("mode") == "range-..", F.col("left_sha")).when(based, F.col("common"))
    target = F.when(F.col("mode") == "branch", F.col("left_sha")).otherwise(F.col("right_sha"))
    error = (
        F.when(F.col("lost").isNotNull(), F.concat(F.lit("unknown revision "), "lost"))
        .when((F.col("mode") == "commit") & (F.size("parents") > 1) & F.col("parent").isNull(), "a merge commit needs a parent")
        .when((F.col("mode") == "commit") & F.when(F.size("parents") == 0, F.col("parent").isNotNull()).otherwise(nth > F.size("parents")), "no such parent")
        .when(based & (F.coalesce("n_bases", F.lit(0)) != 1), F.concat(F.coalesce("n_bases", F.lit(0)), F.lit(" merge bases")))
    )
    told = rows.withColumn("error", error).withColumns({"b": base, "t": target})
    ok = F.col("error").isNull()
    base_label = F.when(F.col("mode").isin("working", "staged"), "HEAD").when(F.col("mode") == "unstaged", "index").when(F.col("mode") == "branch", F.concat(F.lit("merge-base(HEAD,"), "branch", F.lit(")"))).when(F.col("mode") == "pr", F.concat(F.lit("merge-base("), "left_sha", F.lit(","), "right_sha", F.lit(")"))).otherwise(F.col("b"))
    head_label = F.when(F.col("mode") == "staged", "index").when(F.col("mode").isin("working", "unstaged"), "working-tree").when(F.col("mode") == "branch", "HEAD").otherwise(F.col("t"))
    null = F.lit(None).cast("string")
    out = told.select("id", "mode", F.when(ok, F.col("b")).alias("base"), F.when(ok, F.col("t")).alias("target"), F.when(ok, base_label).alias("base_label"), F.when(ok, head_label).alias("head_label"), "error")
    return out.unionByName(bad.select("id", null.alias("mode"), null.alias("base"), null.alias("target"), null.alias("base_label"), null.alias("head_label"), "error"))


def comparison_id(repository: Column, mode: Column, base: Column, target: Column, base_tree: Column, head_tree: Column, parent: Column) -> Column:
    return F.sha2(F.concat(F.lit("comparison/v1\n"), F.to_json(F.array(*[c.cast("string") for c in (repository, mode, base, target, base_tree, head_tree, parent)]))), 256)


def portable(comparisons: DataFrame) -> DataFrame:
    """Without the local root."""
    return comparisons.drop("repository_root")


def changed_meanwhile(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, before, after of comparisons of changeable scopes whose fingerprint (id, mode, fingerprint) isn't the same at the end as at the start."""
    mine = before.where(F.col("mode").isin("staged", "unstaged", "working")).select("id", F.col("fingerprint").alias("before"))
    return mine.join(after.select("id", F.col("fingerprint").alias("after")), "id", "left").where("NOT (before <=> after)")
