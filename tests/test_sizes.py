from diffloom.operators import citations
from diffloom.plans import registry
from diffloom.sources import substrate


def test_tasks_of_documents_follow_their_bytes(spark, monkeypatch):
    """Windows over lines run where texts are dealt, so a task's memory is bounded by its share."""
    at = "/root/testdata/sf0.001"
    monkeypatch.setattr(substrate, "SHARE", 2000)
    files, _, placed, _ = substrate.substrate(spark, at)
    n = files.rdd.getNumPartitions()
    assert n > spark.sparkContext.defaultParallelism and placed.rdd.getNumPartitions() == n
    monkeypatch.setattr(substrate, "SHARE", 1000)
    assert substrate.files(spark, at).rdd.getNumPartitions() in (2 * n - 1, 2 * n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_lies_by_file_is_not_shuffled_again(spark):
    """Written tables lie in buckets by file, so joins, groups and windows by file and others need no exchange, and none sends a side to the driver."""
    assert "Exchange" not in plan(registry.QUERIES["evidence_markdown"](spark, "/root/testdata/sf0.001"))


def test_facts_of_files_are_merged(spark):
    assert "BroadcastExchange" not in plan(registry.QUERIES["graph_both_sides"](spark, "/root/testdata/sf0.001"))


def test_lines_of_spans_meet_the_snapshot(spark):
    """A span whose range the snapshot lacks in part has no citation; overlapping spans each have theirs."""
    spans = spark.createDataFrame([(1, "after", "a", "a", f"s{x}-{y}", x, y, ["l"]) for x, y in ((1, 2), (2, 3), (4, 5), (7, 7))], "doc_id long, side string, old_path string, new_path string, span_id string, start_line long, end_line long, line_ids array<string>")
    snapshot = spark.createDataFrame([(1, "p", side, n, f"{side}{n}") for side in ("after", "before") for n in (1, 2, 3, 5, 7)], "doc_id long, path string, side string, line long, content string")
    found = {r.span_id: r.text for r in citations.citations(spans, snapshot).collect()}
    assert found == {"s1-2": "after1\nafter2", "s2-3": "after2\nafter3", "s7-7": "after7"}


def test_whole_budget_orders_sizes_and_no_texts(spark, monkeypatch):
    from diffloom.operators import order

    seen, real = [], order.written
    monkeypatch.setattr(order, "written", lambda s, df, label: (seen.append(df.columns), real(s, df, label))[1])
    rows = [(k, "after", "p", f"s{k}", 1, 1, "x" * 50 * k, f"c{k}", "h") for k in range(1, 9)]
    cited = spark.createDataFrame(rows, "doc_id long, side string, path string, span_id string, start_line long, end_line long, text string, citation_id string, content_hash string")
    whole = citations.whole_budget(cited, 4000)
    both = cited.selectExpr("*", "1 AS one")
    assert sorted(whole.collect()) == sorted(citations.budget(both, 4000, "one").drop("one").collect())
    assert seen and not any("text" in columns for columns in seen)
