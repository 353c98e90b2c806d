import base64
import json
import random

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from diffloom.llm import line_dedup, near_units, ngram_join, secrets, shared

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_definition_for_lines_of_any_length(spark):
    """Lines of many lengths with one to nine letters changed: linked just where their sets say so."""
    r = random.Random(1)
    letters = "".join(chr(k) for k in range(0x4E00, 0x5E00))
    pairs = {}
    for n in (40, 60, 90, 99, 100, 120, 148, 152, 160, 200, 250):
        for k in range(1, 10):
            line = "".join(r.choice(letters) for _ in range(n))
            other = list(line)
            for at in r.sample(range(n), k):
                other[at] = "#"
            pairs[2 * len(pairs)] = line, "".join(other)
    rows = [(d + e, t, "en", "a", 1) for d, both in pairs.items() for e, t in enumerate(both)]
    got = {x.doc_id for x in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()}
    linked = {d for d, (a, b) in pairs.items() if brute.line_links(a, b)}
    near = {d for d in linked if len(brute.grams(pairs[d][0], line_dedup.SHINGLE) & brute.grams(pairs[d][1], line_dedup.SHINGLE)) * 100 >= 84 * len(brute.grams(pairs[d][0], line_dedup.SHINGLE) | brute.grams(pairs[d][1], line_dedup.SHINGLE))}
    gone = {d for d in pairs if d + 1 not in got}
    assert set(pairs) <= got and near <= gone <= linked and len(near) >= 15


def test_near_copies_with_repeated_and_null_ids(spark):
    base = " ".join(f"word{k}" for k in range(200))
    near = base.replace("word100", "other")
    rows = [(1, base), (1, near), (None, base), (None, near), (None, near), (7, "quite " + base), (9, "something else " * 30)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], DOCS)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "x").collect())
    assert [d for d, _ in got] == [1, 9] and got[0][1] in (base, near)
    none = spark.createDataFrame([(None, t, "en", "a", len(t)) for _, t in rows[2:5]], DOCS)
    assert corpus_pipeline.near_duplicates(spark, none, "x").count() == 1


def test_scratch_of_a_stage_stays_while_it_is_read(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * 40, "en", "a", 1) for k in range(5)], DOCS)
    lazy = corpus_pipeline.lines(spark, docs, "y")
    again = corpus_pipeline.near_duplicates(spark, lazy, "y")
    other = corpus_pipeline.near_duplicates(spark, docs, "z")
    assert again.count() == other.count() == 5


def test_pairs_at_the_limit_are_decided_by_whole_hashes(spark):
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))

    def other(n):
        b = a.copy()
        b[:n] ^= np.uint64(1 << 40)
        return np.unique(b)

    sets = {1: a, 2: other(len(a) // 9), 3: other(len(a) // 9 + 1), 4: other(len(a) // 9 - 1), 5: other(len(a) // 2), 6: other(5)}
    known = spark.createDataFrame([(k, len(x), ngram_join.parity_sketch(x).tobytes(), ngram_join.packed(x)) for k, x in sets.items()], "node long, n int, sketch binary, items binary")
    whole = spark.createDataFrame([(k, x.tobytes()) for k, x in sets.items()], "node long, items binary")
    asked = []

    def exact(nodes):
        asked.extend(x.node for x in nodes.collect())
        return whole

    pairs = spark.createDataFrame([(1, k) for k in range(2, 7)], "u long, v long")
    got = sorted(x.v for x in ngram_join._verified(pairs, known, shared.Scratch(spark, "test"), 80, ngram_join.as_sets, exact).collect())
    both = {k: len(np.intersect1d(a, x)) for k, x in sets.items()}
    assert got == [k for k in range(2, 7) if 100 * both[k] >= 80 * (2 * len(a) - both[k])]
    assert sorted(set(asked)) == [1, 2, 3, 4]


def test_secret_sql_on_random_texts():
    """The SQL has the same spans as the operator, checksums and headers included."""
    r = random.Random(4)
    parts = ["password", "PassWd", "ſecret", "toKen", "api_key", "APIKEY", ":", "=", " ", '"', "AKIA", "0", "deadbeef" * 5, "abcDEF12", "ghp_", "eyJ", ".", "-", "\n", "é", "a" * 36]

    def planted():
        body = "".join(r.choice(secrets.DIGITS) for _ in range(30))
        header = json.dumps(r.choice([{"alg": "x"}, {"a": 1}, [1], "alg", {"alg": {"k": "ÿ"}}]), ensure_ascii=r.random() < 0.5)
        return r.choice(["ghp_" + body + secrets.checksum(body), base64.urlsafe_b64encode(header.encode()).decode().rstrip("=") + r.choice(["", "A"]) + ".ab-.q_1"])

    texts = ["".join(planted() if r.random() < 0.2 else r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + [None, ""]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}))
    got = dict(c.sql(f"SELECT doc_id, spans FROM ({secrets.OP4_SQL})").fetchall())
    keywords = secrets.automaton()
    want = {k: secrets.joined(secrets.spans_of(t or "", keywords)) for k, t in enumerate(texts)}
    assert got == want and any("checked" in x for x in want.values()) and any("jwt" in x for x in want.values())


def test_keys_travel_packed(spark, monkeypatch):
    """Keys of one node, of two near or unlike ones, of many, and one of so many that it goes on as it comes; moved as few rows, found whatever the buckets."""
    for name, value in (("GROUP", 8), ("PACK", 100), ("HOLD", 150)):
        monkeypatch.setattr(near_units, name, value)
    r = np.random.default_rng(5)
    common, several, near, unlike = r.integers(-(1 << 63), 1 << 63, 4).tolist()
    rows, want = [], set()
    for node in range(300):
        keys = [int(x) for x in r.integers(-(1 << 63), 1 << 63, 3)] + [common]
        sign = int(r.integers(-(1 << 63), 1 << 63))
        want.add((common, node))
        if node % 20 == 0:
            keys.append(several)
            want.add((several, node))
        if node in (3, 4):
            keys.append(near)
            sign = 77
            want.add((near, node))
        if node in (5, 6):
            keys.append(unlike)
            sign = [0, -1][node - 5]
        rows.append((node, sign, 0, keys))
    rows += [(300, 0, 0, []), rows[7]]
    df = spark.createDataFrame(rows, "node long, sign long, more int, keys array<long>").repartition(3)
    for buckets in (1, 7):
        packed = near_units.packed_keys(df, buckets)
        assert packed.count() < 200 and packed.select("bucket").distinct().count() == buckets
        assert {(x.key, x.node) for x in near_units.met_keys(packed, 5).collect()} == want
    assert near_units.met_keys(near_units.packed_keys(df.where("false"), 2), 5).count() == 0


def test_keys_that_join_nothing_more_are_not_planned(spark, monkeypatch):
    """Keys of two nodes each are settled by their links alone, so the search within keys isn't planned at all."""

    def no(*_):
        raise AssertionError("planned")

    monkeypatch.setattr(ngram_join, "_dealt", no)
    base = [f"word{k}" for k in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:100], "other", *base[101:]])), (3, "something else " * 30)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark, spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_pairs_are_compared_once_and_equal_items_expanded_once():
    """Neither the order of a pair nor the repeats of an item make more work; what links is what sets say."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 70, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[k:], r.integers(0, 1 << 63, k % 7, dtype=np.uint64)))) for k in range(20)]
    sketches = [ngram_join.parity_sketch(x) for x in sets]
    n, rows = np.array([len(x) for x in sets]), np.arange(len(sets))
    assert len({len(x) for x in sketches}) > 1
    linked = {(i, j) for j in rows.tolist() for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    found = [tuple(sorted(x)) for k, j in ngram_join._hits(n, rows, sketches, rows, rows, 80) for x in zip(k.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found)) and linked and linked <= set(found)
    across = [x for k, j in ngram_join._hits(n, rows, sketches, rows[:10], rows[10:], 80) for x in zip(k.tolist(), j.tolist(), strict=True)]
    assert len(across) == len(set(across)) and {x for x in linked if x[0] < 10 <= x[1]} <= set(across)

    asked = []

    def expand(items):
        asked.extend(items.to_pylist())
        return ngram_join.whole_sets(items)

    pairs = [(0, j) for j in range(1, 20)]
    left, right = ([sets[p[at]].tobytes() for p in pairs] for at in (0, 1))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 19), pa.array(range(1, 20)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["u", "v", "ia", "ib"])
    got = {(0, v) for out in ngram_join._similar(80, expand, False)([batch]) for v in out.column("v").to_pylist()}
    assert got == {x for x in linked if x[0] == 0} and len(asked) == 20


def test_sets_and_keys_against_plain_ones():
    r = np.random.default_rng(7)
    hashes = r.choice(r.integers(0, 1 << 63, 900, dtype=np.uint64) << np.uint64(1), 3000)
    first = np.concatenate(([0], np.sort(r.choice(np.arange(1, 3000), 699, replace=False))))
    parts = np.split(hashes, first[1:])
    keys, sign, more = near_units.signature_keys(hashes, first, 14, 4)
    factors = [int(x) for x in shared.mix(np.arange(1, 57, dtype=np.uint64))]
    for k in (0, 1, 511, 512, 699):
        low = parts[k] >> np.uint64(32)
        least = [int(shared.mix(np.array([min((int(x) * (f & 0xFFFFFFFF | 1) & 0xFFFFFFFF) ^ (f >> 32) for x in low)], np.uint64))[0]) for f in factors]
        want = []
        for band in range(14):
            key = band + 1
            for x in least[4 * band : 4 * band + 4]:
                key = int(shared.mix(np.array([(key * 0x9E3779B97F4A7C15 + x) % (1 << 64)], np.uint64))[0])
            want.append(key)
        assert keys[k].view(np.uint64).tolist() == want
        assert int(sign.view(np.uint64)[k]) == sum((x & 3) << 2 * i for i, x in enumerate(least[:32])) and int(more.view(np.uint32)[k]) == sum((x & 3) << 2 * i for i, x in enumerate(least[32:48]))
    assert all((a == np.unique(b)).all() for a, b in zip(near_units.sorted_sets(hashes.copy(), first), parts, strict=True))
    a, b = (np.sort(r.integers(0, 50, 40).astype(np.uint64)) for _ in range(2))
    assert ngram_join.in_both(a, b) == len(np.intersect1d(a, b)) and ngram_join.in_both(a, a[:0]) == 0
