"""Vector codes, exact search and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diffloom.llm import code_compression, fill_middle, impact_index, shared

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, v string, key int, own int"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, e, n, "x", 1, 2) for i, e, n in rows], VECTORS)


def kept_of(rows, scale):
    """Rows with integers that fit a long, as the operators state."""
    held = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(x * scale)))
    return [(i, [held(x) for x in e], n) for i, e, n in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = kept_of(rows, 4096)
    width = max(1, -(-max(len(v) for _, v, _ in rows) // parts)) * parts
    step = width // parts
    rows = [(i, v + [0] * (width - len(v)), n) for i, v, n in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * step : (p + 1) * step] for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [(v[p * step : (p + 1) * step], near(v[p * step : (p + 1) * step], books[p])[1]) for _, v, _ in rows]
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := [x for x, e in own if e == k]) else book for k, book in enumerate(books[p])]
    out = []
    for i, v, n in rows:
        found = [near(v[p * step : (p + 1) * step], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), (1 << 63) - 1), n))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def some_vectors(seed, n, dims, spread=0.2, steps=None):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (7, dims))
    x = centres[r.integers(0, 7, n)] + r.normal(0, spread, (n, dims))
    x = np.round(x * steps) / steps if steps else x
    return [(int(k), v.tolist(), int(k) % 3 if k % 5 else None) for k, v in enumerate(x)]


ODD = [(None, [1.0] * 16, 1), (None, [0.5] * 16, 1), (3, [float("nan")] * 16, 1), (4, [None, 1.0], 2), (5, None, 2), (6, [], None), (7, [float("inf")] + [0.0] * 15, 1), (8, [0.25, -0.5, 3.0], 1), (8, [0.25, -0.5, 3.0], 1)]


@pytest.mark.parametrize(
    "rows",
    [some_vectors(1, 300, 16), some_vectors(2, 200, 24, 1.0), some_vectors(3, 200, 8, 0.5, 2), some_vectors(4, 60, 16) + ODD, some_vectors(5, 40, 10)[:5], [(1, [1e300, -1e300, 5.0, 1e12], 1), (2, [-1e300, 0.0, 1e9, 2.0], 1), (3, [1.0, 2.0, 3.0, 4.0], None), (0, [1e12] * 4, 1)]],
    ids=["clusters", "spread", "ties", "odd", "few", "huge"],
)
def test_codes_are_those_of_plain_rounds(spark, rows):
    coded, books = code_compression.compressed(spark, vector_rows(spark, rows).repartition(3))
    want, digest = plain_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in coded.collect()), key=key) == sorted(want, key=key)
    assert books.digest() == digest


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], 1)]):
        coded, books = code_compression.compressed(spark, vector_rows(spark, rows))
        assert coded.count() == 0 and books is None


def test_bounds_leave_groups_out():
    r = np.random.default_rng(1)
    centres = r.integers(-9000, 9000, (16, 8))
    x = centres[r.integers(0, 16, 4000)] + r.integers(-200, 200, (4000, 8))
    books = code_compression.Books([[[int(c) for c in v] for v in centres]])
    own, low = np.zeros(len(x), np.int64), np.full((len(x), len(books.drift[0])), -1.0)
    taken = []
    for _ in range(4):
        own, least, low, n = code_compression.assign(x, books.arrays()[0], books.groups[0], own, low, books.drift[0])
        taken.append(n)
        d = ((x[:, None] - books.arrays()[0]) ** 2).sum(-1)
        assert (own == d.argmin(1)).all() and (least == d.min(1)).all()
        books.moved([[x[own == e].sum(0).tolist() for e in range(16)]], [[int((own == e).sum()) for e in range(16)]])
    assert taken[0] > 16 * len(x) and max(taken[1:]) < 2 * len(x)


def plain_top(rows, every=20, k=20):
    rows = kept_of(rows, 64)
    out = []
    for a, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w, _) in enumerate(rows) if a != b]
            out += [(i, n + 1, None if none else j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, none, j) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(
    "rows",
    [some_vectors(1, 400, 16), some_vectors(2, 300, 24, 3.0), some_vectors(3, 300, 4, 0.5, 1), some_vectors(4, 60, 16) + ODD, some_vectors(5, 12, 10), [(k, [10.0 ** (k % 12), -(10.0 ** (k % 7)), 1e30 * (k % 2), 0.1], 1) for k in range(60)], [(k, [1.0, 2.0], 1) for k in (0, 0, 20, 5, 5, None)], [(0, [], 1), (20, [0.0], 1), (1, [0.0, 0.0], 1)]],
    ids=["clusters", "spread", "ties", "odd", "few", "huge", "repeated", "zeros"],
)
@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 16), (900, 40)], ids=["one", "many"])
def test_top_k(spark, rows, sizes):
    got = impact_index.top_k(spark, vector_rows(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, group=sizes[0], block=sizes[1])
    key = lambda r: (r[0], r[1], str(r[2]), r[3])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_top(rows), key=key)


def test_top_k_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0], 1)], [(None, [1.0], 1)]):
        assert impact_index.top_k(spark, vector_rows(spark, rows), F.col("vec_id") % 20 == 0).count() == 0


def test_index_is_in_order_and_stops_early():
    r = np.random.default_rng(7)
    centres = r.normal(0, 12, (40, 32))
    values = np.round(centres[r.integers(0, 40, 2000)] + r.normal(0, 2, (2000, 32))).astype(np.int64)
    index = impact_index.Index(impact_index.index_of(values))
    assert (np.diff(np.abs(index.impacts)) <= 0).all() and len(index.place) == (values != 0).sum()
    # a segment holds one impact of one dimension, and quantised impacts are near what they stand for
    ends = np.append(index.segments[1:], len(index.place))
    for a, b, impact in zip(index.segments, ends, index.impacts, strict=True):
        assert len(set(index.place[a:b] // index.n)) == 1
        true = values.T.ravel()[index.place[a:b]]
        assert (np.abs(true - impact) <= np.abs(true) / 32).all()
    # lengths not accounted for bound every score at every pass
    total = np.zeros((50, index.n))
    for p in range(len(index.passes)):
        total += values[:50].astype(float) @ index.plane(p, np.float64)
        assert (np.abs(values[:50] @ values.T - total) <= np.linalg.norm(values[:50], axis=1)[:, None] * index.rest[p] + 1e-6).all()
    found = list(impact_index.possible(index, values[:50], np.arange(50), 20))
    assert sorted(q for q, _, _ in found) == list(range(50))
    assert min(p for _, _, p in found) < len(index.passes) and np.mean([len(rows) for _, rows, _ in found]) < index.n / 10


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def plain_middle(doc_id, text):
    text = text or ""
    u = units(text)
    n = len(u)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "Bc", "zZ", " ", "\n", "é", "日", "😀", "<", ">", "P", "S", "<P", "M>", "0", "_", "[", "@", "`", "{"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_fill_in_middle(spark, monkeypatch):
    texts = [*random_texts(3, 300), "", None, "", "<P>", "x<S>y", "<M>", "<P", ">", "abc", "é", "a" * 100_000, "é a" * 700_000, "< P>"]
    rows = [(k if k % 11 else None, t, "x", 1) for k, t in enumerate(texts)] + [(5, "the same id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(2)
    made = fill_middle.fill_in_middle(docs).withColumn("restored", fill_middle.restored()).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((plain_middle(i, t) for i, t, *_ in rows), key=key)
    assert sorted(r.restored for r in made) == sorted(t or "" for _, t, *_ in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize("cut", [1, 40, 1 << 20])
def test_kernel_over_slices(cut):
    texts = random_texts(9, 500)
    array = pa.array(["skipped", *texts, None]).slice(1)
    got = []
    for i, j in shared.blocks(shared.string_buffers(array)[1], cut):
        columns = fill_middle.transformed(list(range(i, j)), array.slice(i, j - i))
        got += zip(range(i, j), *(c.to_pylist() for c in columns), strict=True)
    assert got == [plain_middle(k, t) for k, t in enumerate([*texts, None])]


def test_no_side_of_a_search_is_broadcast(spark):
    """The queries' file is small; with a copy for each group they are not."""
    rows = vector_rows(spark, some_vectors(1, 400, 16)).withColumn("vec_id", F.col("vec_id").cast("long"))
    plan = impact_index.top_k(spark, rows, F.col("vec_id") % 20 == 0, group=900, block=40)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
