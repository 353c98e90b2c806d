"""A Bloom filter of nodes, of bounded size, that tasks look candidates up in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mix

_U = np.uint64
#: Least and most bits of a filter (8 MB), and the words of a piece of it that tasks combine.
FILTER_BITS, FILTER_PIECE = (1 << 20, 1 << 26), 1024


def places_of(nodes: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each node, a row for each of its hash functions."""
    return np.stack([mix(nodes.astype(_U) + _U(k * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(bits - 1) for k in (1, 2, 3)]).astype(np.int64)


def passes(words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = places_of(nodes, 64 * len(words))
    return ((words[at >> 6] >> (at & 63).astype(_U)) & _U(1)).all(axis=0)


def filter_bits(n: int) -> int:
    """About 8 bits a node, a power of two within FILTER_BITS."""
    bits, most = FILTER_BITS
    while bits < min(8 * n, most):
        bits *= 2
    return bits


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of a bounded number of bits, whatever the number of nodes; what it lets pass is joined exactly afterwards."""
    bits = filter_bits(nodes.count())

    def run(batches):
        words = np.zeros(bits // 64, _U)
        for batch in batches:
            at = places_of(batch.column("node").to_numpy(), bits).ravel()
            np.bitwise_or.at(words, at >> 6, _U(1) << (at & 63).astype(_U))
        pieces = words.reshape(-1, FILTER_PIECE)
        full = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pieces[k].tobytes() for k in full], pa.binary())], ["piece", "bits"])

    def either(t: pa.Table) -> pa.Table:
        joined = np.zeros(FILTER_PIECE, _U)
        for c in t.column("bits").chunks:
            for x in c:
                joined |= np.frombuffer(x.as_buffer(), _U)
        return pa.table({"piece": pa.array([t.column("piece")[0].as_py()], pa.int32()), "bits": pa.array([joined.tobytes()], pa.binary())})

    out = np.zeros((bits // 64 // FILTER_PIECE, FILTER_PIECE), _U)
    for r in nodes.mapInArrow(run, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), _U)
    return out.ravel()
