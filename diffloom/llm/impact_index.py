"""Exact top-k search: an impact-ordered index of integer vectors, worked off score at a time.

Rows are dealt to groups of bounded size. A group's index has a posting for
every component that isn't 0: its size quantised to few bits (the impact), its
sign, dimension and row. Postings of one impact, sign and dimension are a
segment; segments are stored by descending impact and fall into passes that end
where an impact ends. After each pass the index knows for every row how long
the vector is that its processed impacts don't account for, so that by
Cauchy-Schwarz a row's score lies within that length times the query's from
what has been accumulated. Rows whose upper bound is below the k-th lower bound
can't be members; a query stops at the first pass that leaves few possible
members, or after the last, and all possible members are scored exactly from
the group's forward vectors. The proof holds at any stop, so neither bounds nor
passes change results, only the work.

Queries are packed into blocks, and every block meets every group once, as one
row of two bounded payloads. Of each meeting k rows go on; ranks are taken over
those.

Vectors that are null or hold null or non-finite components take no part, nor
do they as queries. Missing components of shorter vectors count as 0; an empty
vector scores 0. Components whose integer isn't a long are held at the nearest
long; scores likewise, but ranked by their true value. A null id
is no query and comes last in ties. Repeated ids are rows of their own: a row
isn't its own candidate, another one of its id is, and rows that tie in id too
come in an arbitrary order that doesn't show. Extra columns are ignored; an
empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .code_compression import LONG, integer_vectors, matrix
from .shared import Scratch, table

SCALE, K, EVERY = 64, 20, 20
#: Components of a group's vectors and of a block's; a task holds one of each with its bounds. Each block takes a copy of
#: the index, so blocks are only smaller, by SPLIT at most, where there would be fewer than TASKS pairs for a core.
GROUP, BLOCK, SPLIT, TASKS = 1 << 20, 1 << 19, 8, 2
#: Bits of an impact that are kept, and the shares of the postings after which a pass ends.
BITS, PASSES = 5, (0.5, 0.75, 0.9, 1.0)
#: A query stops where no more than one in so many rows of a group is a possible member.
FEW = 32
#: Queries that are accumulated together.
TOGETHER = 128
#: Bytes that hold any score, and what is added so that it isn't negative.
WIDTH, HALF = 20, 1 << 159


def quantised(size: np.ndarray) -> np.ndarray:
    """Sizes with their first bits kept and the middle of what the others may be."""
    shift = np.maximum(0, np.frexp(size.astype(np.float64))[1].astype(np.int64) - BITS)
    return ((size >> shift) << shift) + ((1 << shift) >> 1)


def packed(values: np.ndarray) -> tuple[bytes, str]:
    """An integer matrix in the least type that holds it."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(kind).tobytes(), np.dtype(kind).str


def index_of(values: np.ndarray) -> dict:
    """The index of a group: segments by descending impact, passes, lengths not accounted for, forward vectors."""
    values = values.astype(np.int64)
    n, dims = values.shape
    flat = values.T.ravel()  # a place is dimension * n + row
    held = np.maximum(flat, -LONG)
    impact = quantised(np.abs(held))
    place = np.flatnonzero(flat)
    order = np.lexsort((place, flat[place] < 0, -impact[place]))
    place = place[order]
    level, negative = impact[place], flat[place] < 0
    # a segment is a run of one impact, sign and dimension
    begins = np.flatnonzero(np.diff(level, prepend=-1).astype(bool) | np.diff(negative.astype(np.int8), prepend=-1).astype(bool) | np.diff(place // max(n, 1), prepend=-1).astype(bool)) if len(place) else np.zeros(0, np.int64)
    ends_of_level = np.append(np.flatnonzero(np.diff(level)) + 1, len(place)) if len(place) else np.zeros(1, np.int64)
    passes = sorted({int(ends_of_level[np.searchsorted(ends_of_level, share * len(place))]) for share in PASSES})
    left, rest, done = held.astype(np.float64), np.zeros((len(passes), n)), 0
    for k, end in enumerate(passes):
        p = place[done:end]
        left[p] -= np.sign(left[p]) * impact[p].astype(np.float64)
        rest[k], done = np.sqrt((left.reshape(dims, n) ** 2).sum(axis=0)), end
    forward, kind = packed(values)
    return {
        "n": n, "dims": dims, "forward": forward, "kind": kind, "place": place.astype(np.int32).tobytes(), "segments": begins.astype(np.int32).tobytes(), "passes": passes,
        "impacts": np.where(negative[begins], -level[begins], level[begins]).tobytes(), "rest": np.nextafter(rest.astype(np.float32), np.float32(np.inf)).tobytes(),
    }


INDEX = "n int, dims int, forward binary, kind string, place binary, segments binary, passes array<int>, impacts binary, rest binary"


class Index:
    """An index as it is read from its row."""

    def __init__(self, row: dict):
        self.n, self.dims = row["n"], row["dims"]
        self.forward = np.frombuffer(row["forward"], row["kind"]).reshape(self.n, self.dims)
        self.place, self.segments, self.impacts = (np.frombuffer(row[c], t) for c, t in (("place", np.int32), ("segments", np.int32), ("impacts", np.int64)))
        self.passes, self.rest = row["passes"], np.frombuffer(row["rest"], np.float32).reshape(-1, self.n).astype(np.float64)
        self.planes: dict[int, np.ndarray] = {}
        self.largest = int(np.abs(self.forward.astype(np.float64)).max(initial=0.0)) + 1

    def plane(self, k: int, kind) -> np.ndarray:
        """The signed impacts of a pass's segments by dimension and row."""
        if k not in self.planes:
            begin, end = self.passes[k - 1] if k else 0, self.passes[k]
            a, b = np.searchsorted(self.segments, [begin, end])
            out = np.zeros(self.dims * self.n, kind)
            out[self.place[begin:end]] = np.repeat(self.impacts[a:b], np.diff(np.append(self.segments[a:b], end)))
            self.planes[k] = out.reshape(self.dims, self.n)
        return self.planes[k]


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, as longs where they surely are, otherwise as Python's integers."""
    most = float(np.abs(rows.astype(np.float64)).max(initial=0.0)) * float(np.abs(query.astype(np.float64)).sum())
    if most < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return (rows.astype(object) * query.astype(object)).sum(axis=1)


def possible(index: Index, queries: np.ndarray, own: np.ndarray, k: int):
    """For each query the rows that may be among its k best; own: the query's row in this group, or -1. Yields (query, rows, passes)."""
    width = max(index.dims, queries.shape[1])
    wide = np.zeros((len(queries), width))
    wide[:, : queries.shape[1]] = queries
    wide = wide[:, : index.dims]
    length = np.sqrt((wide**2).sum(axis=1)) * (1 + 1e-6)
    # sums of integers below these sizes are exact; beyond, what may be lost is added to the bounds
    most = np.abs(wide).sum(axis=1).max(initial=0.0) * index.largest * 1.1
    kind = np.float32 if most < 2**24 else np.float64
    slack = 1.0 + (0 if most < 2**53 else most * index.dims * 2.0**-50)
    active, total = np.arange(len(queries)), np.zeros((len(queries), index.n), kind)
    for p in range(len(index.passes)):
        total += wide[active].astype(kind) @ index.plane(p, kind)
        margin = length[active, None] * index.rest[p] + slack
        low = total - margin
        mine = np.flatnonzero(own[active] >= 0)
        low[mine, own[active][mine]] = -np.inf
        least = np.partition(low, index.n - k, axis=1)[:, index.n - k] if index.n > k else np.full(len(active), -np.inf)
        member = low + 2 * margin >= least[:, None]
        member[mine, own[active][mine]] = False
        stops = (member.sum(axis=1) * FEW <= index.n) if p + 1 < len(index.passes) else np.ones(len(active), bool)
        for i in np.flatnonzero(stops):
            yield int(active[i]), np.flatnonzero(member[i]), p + 1
        active, total = active[~stops], total[~stops]
        if not len(active):
            return


def best(index: Index, ids: list, keys: np.ndarray, queries: np.ndarray, query_keys: np.ndarray, k: int):
    """Yields (query, row, score) of the k best rows of this group for each query, ties to smaller ids, then keys."""
    where = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[where], query_keys), len(keys) - 1)
    own = np.where(keys[where][at] == query_keys, where[at], -1)
    none = np.array([x is None for x in ids])
    value = np.array([0 if x is None else x for x in ids], np.int64)
    for begin in range(0, len(queries), TOGETHER):
        part = queries[begin : begin + TOGETHER]
        for q, rows, _ in possible(index, part, own[begin : begin + TOGETHER], k):
            d = min(index.dims, part.shape[1])
            score = exact_scores(index.forward[rows, :d], part[q, :d])
            first = np.lexsort((keys[rows], value[rows], none[rows], -score))[:k]
            for r, s in zip(rows[first].tolist(), score[first].tolist(), strict=True):
                yield begin + q, r, s


def _arrays(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, keys and vectors of a group's rows."""
    width = max((len(v) for v in t.column("v")), default=0)
    return t.column("id").to_pylist(), t.column("key").to_numpy(), matrix(t.column("v"), width).astype(np.int64)


def build_index(rows: DataFrame) -> DataFrame:
    """A row for each group of rows (grp, key, id, v): grp, keys, ids and the columns of INDEX."""

    def run(group, t):
        ids, keys, values = _arrays(t)
        return pa.table({"grp": pa.array([group[0].as_py()], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64()))} | {c: pa.array([x], kinds[c]) for c, x in index_of(values).items()})

    kinds = {"n": pa.int32(), "dims": pa.int32(), "forward": pa.binary(), "kind": pa.string(), "place": pa.binary(), "segments": pa.binary(), "passes": pa.list_(pa.int32()), "impacts": pa.binary(), "rest": pa.binary()}
    return rows.groupBy("grp").applyInArrow(run, f"grp long, keys binary, ids array<long>, {INDEX}")


def pack_queries(rows: DataFrame) -> DataFrame:
    """A row for each block of rows (block, key, id, v): block, qkeys, qids, qvectors, qkind, qdims."""

    def run(group, t):
        ids, keys, values = _arrays(t)
        vectors, kind = packed(values)
        return pa.table({"block": pa.array([group[0].as_py()], pa.int64()), "qkeys": pa.array([keys.tobytes()], pa.binary()), "qids": pa.array([ids], pa.list_(pa.int64())), "qvectors": pa.array([vectors], pa.binary()), "qkind": pa.array([kind]), "qdims": pa.array([values.shape[1]], pa.int32())})

    return rows.groupBy("block").applyInArrow(run, "block long, qkeys binary, qids array<long>, qvectors binary, qkind string, qdims int")


def search(index: DataFrame, queries: DataFrame, groups: int, blocks: int, k: int) -> DataFrame:
    """query, query_id, key, vec_id, score, exact: the k best rows that each group has for each query; exact has the scores' order."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                qdims, found = row["qdims"], ([], [], [], [], [], [])
                query_keys = np.frombuffer(row["qkeys"], np.int64)
                queries, keys = np.frombuffer(row["qvectors"], row["qkind"]).astype(np.int64).reshape(len(query_keys), qdims), np.frombuffer(row["keys"], np.int64)
                for q, r, s in best(Index(row), row["ids"], keys, queries, query_keys, k):
                    for column, x in zip(found, (query_keys[q], row["qids"][q], keys[r], row["ids"][r], max(-LONG - 1, min(LONG, s)), (s + HALF).to_bytes(WIDTH)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if x is found[-1] else pa.int64()) for x in found], ["query", "query_id", "key", "vec_id", "score", "exact"])

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    right = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    # merged, as neither side may pass through the driver: Spark takes the queries' file for their size, of which there is a copy for each group
    return left.hint("merge").join(right, ["grp", "block"]).mapInArrow(run, "query long, query_id long, key long, vec_id long, score long, exact binary")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, embedding) with the highest inner products for each query among them."""
    scratch = Scratch(spark, "impact")
    flagged = vectors.select(F.col("vec_id").alias("id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = scratch.keep(integer_vectors(flagged, scale).select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), "asks", "v"))
    n, asked, dims = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).head()
    groups, blocks = (max(1, -(-count * max(dims or 0, 1) // most)) for count, most in ((n, group), (asked, block)))
    blocks = max(blocks, min(-(-asked * max(dims or 0, 1) * SPLIT // block), -(-TASKS * spark.sparkContext.defaultParallelism // groups)))
    dealt = lambda m, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(m)).cast("long")
    index = scratch.keep(build_index(rows.withColumn("grp", dealt(groups, 1))))
    queries = scratch.keep(pack_queries(rows.where("asks").withColumn("block", dealt(blocks, 2))))
    found = search(index, queries, groups, blocks, k)
    order = Window.partitionBy("query").orderBy(F.col("exact").desc(), F.col("vec_id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM kept q JOIN kept c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST, cr) AS rank FROM scored) WHERE rank <= {K}
"""
