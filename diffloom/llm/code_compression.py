"""Vector code compression: product codes whose codebooks are trained by Yinyang Lloyd rounds in integers.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook of its own that starts as the first rows' parts. Its
entries are clustered into groups once. A row keeps the entry of each part and
for each group one lower bound of the distance to the group's other entries;
after entries have moved, a bound falls by the group's largest drift. A group
is scanned only if its bound no longer exceeds the distance to the best entry
found so far. Distances are exact integers and bounds are rounded downwards, so a
group that might hold a tie is scanned and the result is that of plain Lloyd
rounds. A round is one pass that writes rows with their bounds and each task's
sums; only sums over all tasks, one number per component of a codebook, come
to the driver.

Vectors that are null or hold null or non-finite components are left out.
Shorter vectors, empty ones included, are filled up with zeros to the longest
one, that to a multiple of the parts; there is no limit to the length.
Components whose integer isn't a long are held at the nearest long, errors
likewise. Rows of one id are put in the order of their components when entries
are picked, null ids last; they are rows of their own otherwise. Equal
distances go to the lower index. With fewer rows than entries a codebook has as
many entries as there are rows. Extra columns are ignored; an empty table, or
one with no vector left, gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Groups of a codebook's entries.
GROUPS = 4
#: Bounds are moved by so much of themselves to the safe side, many times what floats lose.
SLACK = 1e-6
#: Beyond this size integers are Python's: squares of differences, summed over a part, would not fit a long.
EXACT = 1 << 26
LONG = (1 << 63) - 1


def integer_vectors(df: DataFrame, scale: int) -> DataFrame:
    """df with v, floor(scale * x) of embedding's components x, without vectors that have none or have one that isn't finite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col("embedding").isNotNull() & finite).withColumn("v", F.transform(x, lambda c: F.floor(c * float(scale))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros, as longs or, where they are large, as Python's integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        out = values[offsets[0] : offsets[-1]].reshape(-1, width)
    else:
        out = np.zeros((len(size), width), np.int64)
        out[np.arange(width) < size[:, None]] = values[offsets[0] : offsets[-1]] if len(size) else []
    return out if not out.size or max(-int(out.min()), int(out.max())) < EXACT else out.astype(object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    return ((x - y) ** 2).sum(axis=-1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def grouped(book: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry: a few rounds of k-means over entries, from entries far from each other."""
    book = book.astype(np.float64)
    picked = [0]
    while len(picked) < min(groups, len(book)):
        far = ((book[:, None] - book[picked]) ** 2).sum(-1).min(1)
        picked.append(int(far.argmax()))
    centres = book[picked]
    for _ in range(5):
        own = ((book[:, None] - centres) ** 2).sum(-1).argmin(1)
        centres = np.stack([book[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return own


def assign(x: np.ndarray, book: np.ndarray, groups: np.ndarray, own: np.ndarray, low: np.ndarray, drift: np.ndarray):
    """The nearest entry of each row of x, squared distances, bounds, and how many distances were taken.

    own: entries of the round before; low: bounds by group, to which the entries' drift since then is applied here.
    """
    low = low - drift
    was = squared(x, book[own])
    best, least, taken, scanned = own.copy(), was.copy(), len(x), []
    for g in range(len(drift)):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(low[:, g] <= roots(least) * (1 + SLACK))
        if len(rows) and len(members):
            d = squared(x[rows, None], book[members])
            k = d.argmin(axis=1)
            entry, near = members[k], d[np.arange(len(rows)), k]
            # integers decide: nearer, or as near with a lower index
            better = (near < least[rows]) | ((near == least[rows]) & (entry < best[rows]))
            best[rows[better]], least[rows[better]] = entry[better], near[better]
            scanned.append((g, members, rows, d))
            taken += d.size
    for g, members, rows, d in scanned:
        away = roots(d)
        away[members == best[rows, None]] = np.inf
        low[rows, g] = away.min(axis=1)
    moved = np.flatnonzero(best != own)
    home = groups[own[moved]]
    low[moved, home] = np.minimum(low[moved, home], roots(was[moved]))
    return best, least, low * (1 - SLACK), taken


class Books:
    """Codebooks (parts, entries, width) with their groups, and how far groups moved last."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.groups = [grouped(np.array(b, dtype=object)) for b in entries]
        self.drift = [np.zeros(int(g.max()) + 1) for g in self.groups]

    def arrays(self) -> list[np.ndarray]:
        large = max((abs(c) for b in self.entries for e in b for c in e), default=0) >= EXACT
        return [np.array(b, dtype=object if large else np.int64).reshape(len(b), -1) for b in self.entries]

    def moved(self, sums: list[list[list[int]]], counts: list[list[int]]) -> None:
        before = self.entries
        self.entries = [[[c // n for c in s] if n else e for e, s, n in zip(*x, strict=True)] for x in zip(before, sums, counts, strict=True)]
        for p, groups in enumerate(self.groups):
            step = roots(squared(np.array(self.entries[p], dtype=object), np.array(before[p], dtype=object))) * (1 + SLACK)
            self.drift[p] = np.array([step[groups == g].max(initial=0.0) for g in range(len(self.drift[p]))])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for b in self.entries for e in b for c in e).encode()).hexdigest()


def _rounds(rows: DataFrame, books: Books, width: int, first: bool) -> DataFrame:
    """rows with their state after one more assignment, and a last row of each task with its sums."""
    arrays, groups, drift, most = books.arrays(), books.groups, books.drift, max(len(d) for d in books.drift)
    parts, entries, step = len(arrays), len(arrays[0]), width // len(arrays)

    def run(batches):
        sums = np.zeros((parts, entries, step + 1), dtype=object)
        for batch in batches:
            if not len(batch):
                continue
            x, n = matrix(batch.column("v"), width), len(batch)
            if first:
                own, low = np.zeros((n, parts), np.uint8), np.full((n, parts, most), -1, np.float32)
            else:
                own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(n, parts).copy()
                low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float32).reshape(n, parts, most).copy()
            error, taken = np.zeros(n, dtype=x.dtype), 0
            for p in range(parts):
                part, k = x[:, p * step : (p + 1) * step], len(drift[p])
                best, least, bounds, scans = assign(part, arrays[p], groups[p], own[:, p].astype(np.int64), low[:, p, :k].astype(np.float64), drift[p])
                own[:, p], low[:, p, :k] = best, bounds
                error, taken = error + least, taken + scans
                for e in np.unique(best):
                    sums[p, e, :step] += part[best == e].sum(axis=0).astype(object)
                    sums[p, e, step] += int((best == e).sum())
            error = error if error.dtype != object else np.array([min(int(e), LONG) for e in error], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array([o.tobytes() for o in own], pa.binary()), pa.array([o.tobytes() for o in low], pa.binary()), pa.array(error, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], names
            )
        one = lambda f: pa.nulls(1, f)
        yield pa.RecordBatch.from_arrays([one(kinds[0]), one(kinds[1]), one(pa.list_(pa.int64())), one(pa.binary()), one(pa.binary()), one(pa.int64()), pa.array([[str(c) for c in sums.ravel()]], pa.list_(pa.string()))], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("vec_id", "label")]
    names = ["vec_id", "label", "v", "own", "low", "error", "sums"]
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind('vec_id')}, label {kind('label')}, v array<long>, own binary, low binary, error long, sums array<string>")


def compressed(spark: SparkSession, vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """vec_id, label, code, error of vectors (vec_id, label, embedding), and the codebooks; none if no vector is left."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    scratch = Scratch(spark, "codes")
    rows = scratch.keep(integer_vectors(vectors.select("vec_id", "label", "embedding"), scale).select("vec_id", "label", "v"))
    longest = rows.agg(F.max(F.size("v"))).head()[0]
    if longest is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = max(1, -(-longest // parts)) * parts
    step = width // parts
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - F.size("v"))).alias("v")
    start = [r.v for r in rows.select("vec_id", filled).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = Books([[r[p * step : (p + 1) * step] for r in start] for p in range(parts)])
    for k in range(rounds + 1):
        last, rows = rows, scratch.keep(_rounds(rows if k == 0 else rows.where("sums IS NULL").drop("sums", "error"), books, width, k == 0))
        scratch.drop(last)
        if k < rounds:
            total = rows.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
            flat = [int(s) for _, s in sorted((r["at"], r["s"]) for r in total)]
            n = len(start)
            each = [[flat[(p * n + e) * (step + 1) : (p * n + e + 1) * (step + 1)] for e in range(n)] for p in range(parts)]
            books.moved([[s[:-1] for s in b] for b in each], [[s[-1] for s in b] for b in each])
    return rows.where("sums IS NULL").select("vec_id", "label", F.lower(F.hex("own")).alias("code"), "error"), books


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(spark, table(spark, sf_dir, "embeddings"))
    per = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return coded.join(per, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """The same by plain Lloyd rounds, one common table expression each."""
    distance = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])"
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"a{k} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e, any_value(x) AS x FROM (SELECT r, p, e, x, CAST({distance} AS BIGINT) AS d FROM parts JOIN c{k} USING (p)) GROUP BY r, p)")
        if k < ROUNDS:
            rounds.append(f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM
  (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, LATERAL (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{', '.join(rounds)},
coded AS (SELECT vec_id, label, code, error FROM kept JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r) USING (r))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded
"""


OP11_SQL = _sql()
