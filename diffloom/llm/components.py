"""Distributed union-find: connected components.

Tasks first join what their own links join, so that a table of links becomes
few stars. Alternating large-star and small-star steps then settle what lies
in several tasks. Only grouped minima and equi-joins are used, so a vertex
with very many links is pre-aggregated on the map side and its join side can
be split by adaptive execution. Every round is a written table.

Loops and repeated links are ignored; no links give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Links that a task joins at once.
HELD = 1 << 20


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and for each the smallest node that it is joined with."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _stars(batches):
    held, n = [], 0

    def joined():
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        some = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(least[some])], ["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("u", "v")))
        n += batch.num_rows
        if n >= HELD:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v) that join the same as edges (u, v): stars of each task's own components, v < u."""
    return edges.select("u", "v").mapInArrow(_stars, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pointed = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pointed.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether every vertex points at one other, which points at none."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).agg(F.count_if((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1)))).first()[0] == 0


def components(scratch: Scratch, edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every vertex that has a link, where root is the component's smallest vertex."""
    at = scratch.keep(contracted(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")))
    for _ in range(rounds):
        if _settled(at):
            break
        new = scratch.keep(contracted(_small_star(_large_star(at))))
        scratch.drop(at)
        at = new
    else:
        raise RuntimeError("the components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
