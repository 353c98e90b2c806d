import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import graph, order
from diffloom.sources import tables


def up_of(edges, node):
    out, todo = {node}, [node]
    while todo:
        for p in edges.get(todo.pop(), ()):
            if p not in out:
                out.add(p)
                todo.append(p)
    return out


@pytest.mark.parametrize(("seed", "n", "parents"), [(1, 60, 1), (2, 60, 2), (3, 40, 3)])
def test_merge_bases_and_descent_against_brute_force(spark, seed, n, parents):
    r = random.Random(seed)
    edges = {k: {r.randint(max(0, k - 8), k - 1) for _ in range(r.randint(1 if r.random() < 0.9 else 0, parents))} for k in range(1, n)}
    rows = spark.createDataFrame([(k, p) for k, ps in edges.items() for p in ps], "node long, parent long")
    asked = [(r.randrange(n + 3), r.randrange(n + 3)) for _ in range(12)] + [(None, 3)]
    want = {}
    for a, b in {x for x in asked if x[0] is not None}:
        both = up_of(edges, a) & up_of(edges, b)
        best = [c for c in both if not any(c != d and c in up_of(edges, d) for d in both)]
        if best:
            want[a, b] = (len(best), min(best))
    got = graph.merge_bases(spark, rows, spark.createDataFrame(asked, "left_node long, right_node long"))
    assert {(x.left_node, x.right_node): (x.n_bases, x.base) for x in got.collect()} == want
    starts = [n - 1, n // 2]
    found = graph.descended(spark, rows, spark.createDataFrame([(s,) for s in starts], "node long"))
    assert sorted(x.node for x in found.collect()) == sorted(up_of(edges, starts[0]) | up_of(edges, starts[1]))


def test_rings(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (6, 5), (7, 1), (8, 8)], "node long, parent long")
    starts = lambda *x: spark.createDataFrame([(k,) for k in x], "node long")
    assert sorted(x.node for x in graph.descended(spark, edges, starts(7)).collect()) == [1, 2, 3, 7]
    assert sorted(x.node for x in graph.descended(spark, edges, starts(2, 8, 99)).collect()) == [1, 2, 3, 8, 99]


def test_rows_of_a_long_chain_follow_its_length(spark, monkeypatch):
    """100,000 commits in a row with two branches at the top: no relation that is written has more rows than there are commits."""
    n, sizes = 100_000, []

    def counting(s, df, label):
        out = tables.written(s, df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counting)
    chain = spark.range(1, n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    tops = spark.createDataFrame([(n + 1, n // 2), (n + 2, n + 1), (n + 3, n // 2)], "node long, parent long")
    got = graph.merge_bases(spark, chain.unionByName(tops), spark.createDataFrame([(n + 2, n + 3), (n - 1, n + 2), (7, n - 1)], "left_node long, right_node long"))
    assert {(x.left_node, x.right_node): (x.n_bases, x.base) for x in got.collect()} == {(n + 2, n + 3): (1, n // 2), (n - 1, n + 2): (1, n // 2), (7, n - 1): (1, 7)}
    assert max(sizes) <= n + 5


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_and_sums(spark, partitions):
    r = random.Random(4)
    rows = [(k, r.choice("abc"), r.randint(-5, 9) if k % 4 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(partitions)
    got = {x.id: (x.place, x.total) for x in order.placed(df, [F.col("g"), -F.col("id")], {"total": F.coalesce("v", F.lit(0))}).collect()}
    total, want = 0, {}
    for n, (k, _, v) in enumerate(sorted(rows, key=lambda x: (x[1], -x[0]))):
        total += v or 0
        want[k] = n + 1, total
    assert got == want
    assert order.placed(df.where("false"), [F.col("id")]).count() == 0


@pytest.mark.parametrize(("seed", "n", "parents"), [(4, 70, 2), (5, 50, 3)])
def test_closure_makes_few_pairs_twice(spark, monkeypatch, seed, n, parents):
    """Pairs are those of brute force, cycles included, and are written once."""
    r, sizes = random.Random(seed), []

    def counting(s, df, label):
        out = tables.written(s, df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counting)
    edges = {k: {r.randint(max(0, k - 6), k - 1) for _ in range(r.randint(1, parents))} for k in range(1, n)} | {0: {3} if seed == 4 else {0}}
    rows = spark.createDataFrame([(k, p) for k, ps in edges.items() for p in ps], "node long, parent long")
    got = [(x.node, x.ancestor) for x in graph.ancestors(spark, rows).collect()]
    want = {(k, a) for k in edges for a in up_of(edges, k)}
    assert len(got) == len(want) and set(got) == want
    assert sum(sizes) == len(want) - n


@pytest.mark.parametrize("seed", [1, 4])
def test_merge_bases_of_all_pairs(spark, seed):
    """Several bases, shortcuts past a common ancestor, ends that are ancestors of one another, two roots, and with seed 4 a ring."""
    r = random.Random(seed)
    edges = {k: {r.randint(max(0, k - r.choice((3, 12))), k - 1) for _ in range(r.randint(1, 3))} for k in range(2, 26)} | ({0: {5}} if seed == 4 else {})
    rows = spark.createDataFrame([(k, p) for k, ps in edges.items() for p in ps], "node long, parent long")
    asked = [(a, b) for a in range(27) for b in range(a % 3, 27, 3)]
    up, want = {k: up_of(edges, k) for k in range(27)}, {}
    for a, b in asked:
        both = up[a] & up[b]
        if best := [c for c in both if not any(c != d and c in up[d] for d in both)]:
            want[a, b] = (len(best), min(best))
    got = graph.merge_bases(spark, rows, spark.createDataFrame(asked, "left_node long, right_node long"))
    assert {(x.left_node, x.right_node): (x.n_bases, x.base) for x in got.collect()} == want
    assert seed == 4 or any(n > 1 for n, _ in want.values())


@pytest.mark.parametrize("depth", [6, 20])
def test_search_of_bases_ends_above_the_rest(spark, monkeypatch, depth):
    """Merges upon merges, which no chain shortens: what a pair at the top writes is the same whatever lies below."""
    sizes = []

    def counting(s, df, label):
        out = tables.written(s, df, label)
        sizes.append(out.count())
        return out

    edges = [(2 * k + x, 2 * k - 2 + y) for k in range(1, depth) for x in (0, 1) for y in (0, 1)]
    top, n = 2 * depth - 2, 60
    edges += [(1000 + k, top + k % 2) for k in range(n)]
    asked = [(1000 + a, 1000 + b) for a in range(n) for b in range(a + 1, n)]
    monkeypatch.setattr(graph, "written", counting)
    got = graph.merge_bases(spark, spark.createDataFrame(edges, "node long, parent long"), spark.createDataFrame(asked, "left_node long, right_node long")).collect()
    want = {(1000 + a, 1000 + b): (1, top + a % 2) if a % 2 == b % 2 else (2, top - 2) for a in range(n) for b in range(a + 1, n)}
    assert {(x.left_node, x.right_node): (x.n_bases, x.base) for x in got} == want
    assert sum(sizes) < 12 * len(asked) + 40 * depth
