import base64
import hashlib
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diffloom.llm import decontaminate, line_dedup, mixing, ngram_join, paragraph_dedup, pii, quality, secrets, shared, warc
from diffloom.llm.queries import QUERIES

from . import brute
from .test_operators import SCHEMA, prose, rows_of

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return shared.table(spark, SMALL, "documents")


def test_quality_verdicts(spark, docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    want = {r.doc_id: v for r, v in zip(rows, brute.verdicts([(r.text, r.lang) for r in rows]), strict=True)}
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(spark, docs).collect()}
    assert got == want and len({k for _, k in got.values()}) == 2


@pytest.mark.parametrize("seed", range(6))
def test_secret_base_spans(seed):
    r = random.Random(seed)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", " ", "=", ":", '"', "'", "AKIA", "A", "B9", "abc", "0f", "deadbeef", "_", ".", "-", "é", "\n", "eyJ"]
    text = "".join(r.choice(parts) for _ in range(3000))
    want = []
    for kind, p, least, group in (("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)):
        want += [(m.start(), m.end(), kind) for m in re.finditer(p, text) if len(m[group]) >= least]
    want.sort(key=lambda x: (x[0], secrets.KINDS.index(x[2])))
    assert [x for x in secrets.spans_of(text, secrets.automaton()) if x[2] in secrets.BASE] == want


def test_secret_tokens():
    find = lambda t: secrets.joined(secrets.spans_of(t, secrets.automaton()))
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'x'})}.{part({'a': 1})}.c2ln"
    assert find(f"see {good}!") == f"jwt:4:{4 + len(good)}"
    assert find(f"{part({'typ': 'x'})}.a.b") == "" and find("eyJ.a.b") == ""
    # a header that nests deeply, and one that is no object
    assert find(base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=") + ".a.b") == ""
    assert find(f"{part(['alg'])}.a.b") == ""


def test_long_runs_take_their_length():
    import time

    took = []
    for n in (100_000, 400_000):
        began = time.time()
        secrets.spans_of("eyJ" * n, secrets.automaton())
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_lines_against_brute_force(spark):
    r, rows = random.Random(4), []
    base = [prose(k, r.randint(2, 40)) for k in range(60)]
    for d in range(50):
        own = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                x[r.randrange(len(x))] = r.choice("qxz")
            own.append("".join(x))
        rows.append((d, "\n".join(own)))
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark, spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, _s int, _d string")).collect()}
    assert got == {d: t for d, t in brute.left_lines(rows).items() if t is not None}


def test_lines_of_odd_rows(spark):
    long = " ".join(prose(k, 200) for k in range(40))
    rows = [(None, long + "\nnull id has this"), (1, long + "\none"), (1, "another text of one"), (1, "another text of one"), (2, "another text of one"), (3, " \n\t"), (4, None), (5, long.replace("river", "rivers", 1))]
    got = sorted((x.doc_id or 99, x.text or "") for x in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(99, "null id has this"), (1, long + "\none"), (1, "another text of one"), (1, "another text of one"), (3, " \n\t"), (4, "")])


def test_windows_find_every_long_run(spark):
    """Where 44 or more words stand in an earlier document, the later one has a removed place among them."""
    r = random.Random(9)
    word = lambda: f"w{r.randint(0, 3000)}"
    runs = [[word() for _ in range(r.randint(44, 80))] for _ in range(30)]
    texts = []
    for _ in range(60):
        parts = [[word() for _ in range(r.randint(0, 60))]]
        for _ in range(2):
            parts += [r.choice(runs), [word() for _ in range(r.randint(1, 60))]]
        texts.append(r.choice([" ", "\n"]).join(" ".join(p) for p in parts if p))
    removed = {}
    for x in paragraph_dedup.repeated_paragraphs(spark, spark.createDataFrame(rows_of(texts), SCHEMA)).where("removed").collect():
        removed.setdefault(x.doc_id, []).append((x.begin, x.end))
    seen, checked = set(), 0
    for d, t in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(brute.WORD, t)]
        words = [t[a:z] for a, z in spans]
        new = [tuple(words[k : k + 44]) for k in range(len(words) - 43)]
        for k, gram in enumerate(new):
            if gram in seen:
                checked += 1
                assert any(a < spans[k + 43][1] and z > spans[k][0] for a, z in removed.get(d, []))
        seen.update(new)
    assert checked > 100


def test_paragraph_bodies_do_not_fuse():
    import pyarrow as pa

    bodies = [" ".join(f"a{k}" for k in range(25)).encode(), " ".join(f"b{k}" for k in range(25)).encode(), " ".join(f"c{k}" for k in range(25)).encode()]
    expand = paragraph_dedup.PARAGRAPHS.expand()
    together = expand(pa.array(bodies, pa.binary()))
    assert [x.tolist() for x in together] == [expand(pa.array([b], pa.binary()))[0].tolist() for b in bodies] and len(together[1]) == 21


def test_passages_of_odd_rows(spark):
    passage = prose(21, 60)
    rows = [(None, passage, 1), (3, passage + " end", 2), (3, passage + " end", 3), (4, None, 4), (5, "", 5)]
    got = paragraph_dedup.repeated_paragraphs(spark, spark.createDataFrame(rows, "doc_id long, text string, keep int")).collect()
    assert {(x.doc_id, x.removed) for x in got if x.removed} == {(None, True)}


def test_recall_of_paraphrases(spark):
    """Items with a quarter of their words replaced, inside other prose."""
    r = random.Random(7)
    items = shared.table(spark, MIDDLE, "benchmark").collect()
    own = shared.table(spark, MIDDLE, "documents")
    filler = [x.text for x in own.where("length(text) > 400").orderBy("doc_id").limit(len(items)).collect()]
    planted = []
    for k, (item, text) in enumerate(zip(items, filler, strict=True)):
        words = item.text.split()
        for p in r.sample(range(len(words)), len(words) // 4):
            words[p] = f"subst{r.randint(0, 10**6)}"
        planted.append((10_000_000 + k, f"{text[:200]} {' '.join(words)} {text[200:400]}"))
    docs = own.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark, docs, shared.table(spark, MIDDLE, "benchmark")).where("doc_id >= 10000000").collect()}
    want = {(10_000_000 + k, x.item_id) for k, x in enumerate(items)}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2


def test_leaks_of_odd_rows(spark):
    text = "some rare quokka walks over seven silver bridges toward another hidden valley tonight"
    docs = spark.createDataFrame([(None, text, 1), (1, text, 2), (2, None, 3), (3, "", 4), (4, "nothing of it", 5)], "doc_id long, text string, _d int")
    items = spark.createDataFrame([(7, text, "quokka bridges"), (8, None, None), (9, "", None)], "item_id long, text string, answer string")
    left = decontaminate.decontaminate(spark, docs, items)
    assert sorted(x._d for x in left.collect()) == [3, 4, 5]


@pytest.mark.parametrize("seed", range(3))
def test_identifiers_against_brute_force(spark, seed):
    r = random.Random(seed)
    parts = ["a@b.example", "x.y+z@c-d.e.f", "10.0.0.1", "300.1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "@", ".", "-", " ", "\n", "word", "é", "7", "12345678901234567890", "+", "("]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, ""]
    held, spans = pii.personal_spans(spark, spark.createDataFrame(rows_of(texts), SCHEMA))
    got = {x.doc_id: [(s.start, s.end, s.kind) for s in x.spans if s.kind != "term"] for x in held.join(spans, "rid").collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, t in enumerate(texts) if (v := brute.identifiers(t))}


def test_disclosures_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for k in range(30):
        lines = [f"{prose(100 * k + j, 4)} {r.choice(['ada', 'bob', 'eve'])}@x.example {r.choice(['wolframite', 'basalt', 'the'])} {prose(200 * k + j, 4)}" for j in range(r.randint(0, 3))]
        texts.append("\n".join([*lines, prose(k, 12)]))
    texts += texts[:5]
    held, spans = pii.personal_spans(spark, spark.createDataFrame(rows_of(texts), SCHEMA))
    got = {x.doc_id: {(s.start, s.end) for s in x.spans if s.kind == "term"} for x in held.join(spans, "rid").collect()}
    want = brute.disclosed(texts)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in enumerate(want) if v} and any(want)


def test_personal_data_of_odd_rows(spark):
    line = "x " * 30_000 + "me@here.example"
    held, spans = pii.personal_spans(spark, spark.createDataFrame([(None, line), (1, line), (1, line)], "doc_id long, text string"))
    rows = held.join(spans, "rid").collect()
    assert len(rows) == 3 and all([(s.start, s.end, s.kind) for s in x.spans] == [(60_000, 60_015, "email")] for x in rows)


def test_links_over_rows_without_id(spark):
    w = prose(31, 60).split()
    a, b, c = " ".join(w), " ".join([*w[:30], "x", *w[31:]]), " ".join([*w[:20], "y", *w[21:30], "x", *w[31:]])
    got = ngram_join.ngram_components(spark, spark.createDataFrame([(1, a, 0), (None, b, 0), (3, c, 0)], "doc_id long, text string, node int")).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, None: None, 3: 1}


def test_components_against_brute_force(spark):
    from diffloom.llm.components import components

    r = random.Random(8)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + r.randint(0, 80), 1000 + r.randint(0, 80)) for _ in range(60)] + [(2000, 2000 + k) for k in range(1, 400)] + [(5, 5)]
    union = brute.Union(3000)
    for a, b in edges:
        union.join(a, b)
    found = components(shared.Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long").repartition(16))
    want = {x: union.find(x) for e in edges if e[0] != e[1] for x in e}
    assert {x.node: x.root for x in found.collect()} == want
    assert components(shared.Scratch(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0


def test_archives_of_others(spark, tmp_path):
    """Other header spelling, other record types, a damaged member, and members inside an uncompressed payload."""
    import zlib

    def member(text, level=6):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(text) + z.flush()

    def rec(kind, block, names=("WARC-Type", "content-length"), level=6):
        return member(f"WARC/1.0\r\n{names[0]}:{kind}\r\nWARC-Record-ID: <urn:page:1>\r\n{names[1]}:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", level)

    inner = rec("response", b"HTTP/1.1 200 OK\r\n\r\ninner") * 3
    good = [rec("warcinfo", b"software: x"), rec("response", b"HTTP/1.1 200 OK\r\n\r\nbody", ("warc-type", "Content-Length")), rec("resource", inner + b"tail" * 50, level=0), rec("response", b"HTTP/1.1 200 OK\r\n\r\nlast")]
    damaged = rec("response", b"x" * 50)[:-6] + b"??????"
    data = good[0] + good[1] + damaged + good[2] + good[3]
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "path string, length long")
    whole = sorted((x.offset, x.record_type, bytes(x.payload)) for x in warc.read_archives(files).collect())
    assert [(k, p) for _, k, p in whole] == [("warcinfo", b"software: x"), ("response", b"body"), ("resource", inner + b"tail" * 50), ("response", b"last")]
    assert warc.parse(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: y\r\n\r\n") is None and warc.parse(b"HTTP/1.1\r\n\r\n") is None


def test_archives_of_odd_rows(spark):
    pages = spark.createDataFrame([(None, "u", "same", 1), (2, "u", "same", 2), (2, "v", "same", 3), (4, None, None, 4)], "page_id long, url string, html string, payload int")
    got = [(x.record_id, x.record_type, x.refers_to) for x in warc.archive(spark, pages)[1].collect()]
    assert sorted(got, key=str) == sorted([("<urn:page:>", "revisit", "<urn:page:2>"), ("<urn:page:2>", "response", None), ("<urn:page:2>", "response", None), ("<urn:page:4>", "response", None)], key=str)


def test_mix_carries_any_name(spark):
    rows = [(k, prose(k, 30), "ab"[k % 2], "l", "k") for k in range(20)]
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key string"), carry=("lang", "key"))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "lang", "key"] and got.count() == 20


def test_pipeline_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()
    kept = [r for r, (_, k) in zip(rows, brute.verdicts([(r.text, r.lang) for r in rows]), strict=True) if k]
    text = {d: t for d, t in brute.left_lines([(r.doc_id, r.text) for r in kept]).items() if t is not None}
    ids = sorted(text)
    first = brute.near_classes([text[d] for d in ids])
    ids = [d for k, d in enumerate(ids) if first[k] == k]
    source = {r.doc_id: r.source for r in rows}
    at = spark.createDataFrame([(d, text[d], source[d]) for d in ids], "doc_id long, text string, source string")
    leaked = {x.doc_id for x in decontaminate.leaks(spark, at, shared.table(spark, SMALL, "benchmark")).collect()}
    c = duckdb.connect()
    c.register("documents", at.where(~F.col("doc_id").isin(list(leaked) or [-1])).toArrow())
    want = {x[0]: x[1:] for x in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP2_SQL}) WHERE taken > 0").fetchall()}
    got = {x.doc_id: (x.size, x.source_size, x.target, x.taken) for x in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and len(got) > 20


def test_pipeline_of_odd_tables(spark, tmp_path):
    shared.table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string"
    long = " ".join(dict.fromkeys(prose(5, 400).split()))
    rows = [(None, long, None, None, None, "x"), (1, None, "en", "s", 0, "x"), (1, long, "en", None, 1, "y"), (2, "", None, None, 2, None), (1, long, "en", None, 1, "z")]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, None}
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_base_hashes(spark, docs):
    """The digests of the queries are those of the spans that they list."""
    for name, base in (("op4_secret_scan", secrets.BASE), ("op10_personal_data", pii.BASE)):
        for x in QUERIES[name](spark, SMALL).collect():
            own = [s for s in x.spans.split(",") if s.split(":")[0] in base]
            assert hashlib.sha256(",".join(own).encode()).hexdigest() == x.base_sha256
