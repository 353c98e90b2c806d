"""Near-duplicate parts of texts: MinHash banding, exact verification, one kept per component.

A unit is a part of a text, such as a line. Units of equal bytes are one node.
Each node's shingle hashes give a MinHash signature; nodes that agree on a band
meet. What meets by chance goes at once: two bits of each hash function make a
short signature, and a node of a small group goes on only if another one's
differs in no more functions than similar ones do (see most_apart). The rest are
held against each other by bit sketches, then by the exact Jaccard similarity
of the full sets, and form components. Of each component the unit that comes
first by document id, text and place is kept.

Rows of one id and one text are one document: what is kept or removed in one
of them is so in all. Null ids come last. Null or empty texts have no units;
repeated lines are several units of one node. Very long texts are scanned in
parts, very long units whole. Extra columns are ignored; an empty table gives
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import node_filter, passes
from .ngram_join import SKETCH, linked, parity_sketch
from .shared import SEEN, Scratch, blocks, counts, mix, range_hashes, string_buffers

_U = np.uint64
PLACE = "doc_id long, text_hash long, no int, begin int, end int, n_words int, word int, node long, sign long, more int, keys array<long>"
#: Hash functions of a signature.
SIGNED = 48
#: Nodes of a key up to which each is held against each by signature; rows of a larger group all go on.
GROUP = 256
#: Keys of a bucket at most, those that a task packs at once, those of a bucket after which the very common ones go on, and bytes of one.
BUCKET, PACK, HOLD, ROW = 1 << 19, 1 << 20, 1 << 21, 28
#: Units whose least hashes are mixed at once.
MIXED = 512
#: Bytes of text that are scanned at once, so that the arrays stay in the processor's cache.
SCAN = 1 << 17


def grams(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of each range, and where each range's hashes start; a shorter range is one window."""
    count = np.maximum(end - begin - width + 1, 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    n = max(len(codes) - width + 1, 0)
    every = range_hashes(codes, slice(0, n), slice(width, None), width) if n else np.zeros(1, _U)
    out = every[np.minimum(np.repeat(begin - first, count) + np.arange(count.sum()), max(n, 1) - 1)]
    short = np.flatnonzero(end - begin < width)
    out[first[short]] = range_hashes(codes, begin[short], end[short])
    return out, first


def sorted_sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each unit in order; those given are sorted in place."""
    ends = [*first[1:].tolist(), len(hashes)]
    for i, j in zip(first.tolist(), ends, strict=True):
        hashes[i:j].sort()
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    new[first] = True
    at = counts(new)
    hashes = hashes[new]
    return [hashes[i:j] for i, j in zip(at[first].tolist(), at[ends].tolist(), strict=True)]


def signature_keys(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, a row for each unit, and a signature with two bits of each hash function, of 32 in a long and of SIGNED - 32 in an int."""
    low = (hashes >> _U(32)).astype(np.uint32)
    value, least = np.empty_like(low), np.empty((bands * rows, len(first)), np.uint32)
    for f, row in zip(mix(np.arange(1, bands * rows + 1, dtype=_U)).tolist(), least, strict=True):
        np.multiply(low, np.uint32(f & 0xFFFFFFFF | 1), out=value)
        np.bitwise_xor(value, np.uint32(f >> 32), out=value)
        np.minimum.reduceat(value, first, out=row)
    out, sign, more = np.empty((len(first), bands), _U), np.zeros(len(first), _U), np.zeros(len(first), np.uint32)
    places = _U(2) * np.arange(SIGNED, dtype=_U)[:, None]
    for i in range(0, len(first), MIXED):
        some = slice(i, i + MIXED)
        mixed = mix(least[:, some])
        bits = mixed[:SIGNED] & _U(3)
        sign[some] = np.bitwise_or.reduce(bits[:32] << places[: len(bits[:32])], axis=0)
        more[some] = np.bitwise_or.reduce(bits[32:] << places[: len(bits[32:])], axis=0)
        by_band = mixed.reshape(bands, rows, -1)
        key = np.arange(1, bands + 1, dtype=_U)[:, None]
        for k in range(rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + by_band[:, k])
        out[some] = key.T
    return out.view(np.int64), sign.view(np.int64), more.view(np.int32)


def most_apart(functions: int, percent: int) -> int:
    """The functions in which signatures of similar units may differ: the mean and 4.5 standard deviations, which of 30,000 pairs at the limit fewer than one exceeds."""
    n, p = min(functions, SIGNED), 0.75 * (100 - percent) / 100
    return int(n * p + 4.5 * (n * p * (1 - p)) ** 0.5)


def apart(a: np.ndarray, b: np.ndarray, odd) -> np.ndarray:
    """In how many pairs of bits signatures differ; odd has every second bit."""
    x = a ^ b
    return np.bitwise_count((x | x >> x.dtype.type(1)) & odd)


def _met(key: np.ndarray, node: np.ndarray, sign: np.ndarray, more: np.ndarray, most: int) -> np.ndarray:
    """The rows, of rows in order of key, that are worth a closer look: of each key the nodes that some other is near, or all if there are many."""
    if not len(key):
        return np.zeros(0, np.int64)
    beside = key[1:] == key[:-1]
    at = np.flatnonzero(np.concatenate((beside, [False])) | np.concatenate(([False], beside)))
    at = at[np.lexsort((node[at], key[at]))]
    at = at[_new(key[at], node[at])]
    key, sign, more = key[at], sign[at].astype(_U), more[at].astype(np.uint32)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else at
    many = np.diff(np.append(begin, len(key)))
    size = np.repeat(many, many)
    keep = size > GROUP
    rows = np.flatnonzero((size > 1) & ~keep)
    for step in range(1, GROUP):
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        if not len(rows):
            break
        far = apart(sign[rows], sign[rows + step], _U(0x5555555555555555)) + apart(more[rows], more[rows + step], np.uint32(0x55555555))
        near = rows[far <= most]
        keep[near] = keep[near + step] = True
    return at[keep]


def _new(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    return np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.zeros(0, bool)


def packed_keys(scanned: DataFrame, buckets: int) -> DataFrame:
    """bucket, rows: the keys of scanned (node, sign, more, keys), many in one value, dealt to so many ranges of keys; for each its key, node, sign and more, column by column."""

    def split(parts: list) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        at = (((columns[0].view(_U) >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.min_scalar_type(buckets))
        order = np.argsort(at, kind="stable")
        columns, at = [x[order] for x in columns], at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rows = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "rows"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column("keys")
            key, many = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            if not len(key):
                continue
            held.append([key, *(np.repeat(batch.column(c).to_numpy(), many) for c in ("node", "sign", "more"))])
            n += len(key)
            if n >= PACK:
                yield split(held)
                held, n = [], 0
        if held:
            yield split(held)

    return scanned.where("size(keys) > 0").select("node", "sign", "more", "keys").mapInArrow(run, "bucket int, rows binary")


def _unpacked(rows: pa.Buffer) -> list[np.ndarray]:
    n = rows.size // ROW
    return [np.frombuffer(rows, kind, n, at * n) for kind, at in ((np.int64, 0), (np.int64, 8), (np.int64, 16), (np.int32, 24))]


def met_keys(packed: DataFrame, most: int) -> DataFrame:
    """The rows (key, node) of packed keys that several nodes have, without those that meet by chance.

    A task holds one bucket at a time. A key of very many nodes goes on as its
    rows come, perhaps some of them twice.
    """

    def joined(parts: list) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(columns[0])
        return [x[order] for x in columns]

    def run(batches):
        bucket, held, n, limit, passing = None, [], 0, HOLD, np.zeros(0, np.int64)

        def met():
            columns = joined(held)
            some = _met(*columns, most)
            return _rows(columns[0][some], columns[1][some])

        for batch in batches:
            for at, x in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
                if at != bucket:
                    if held:
                        yield met()
                    bucket, held, n, limit, passing = at, [], 0, HOLD, passing[:0]
                columns = _unpacked(x.as_buffer())
                if len(passing) and (through := np.isin(columns[0], passing)).any():
                    yield _rows(columns[0][through], columns[1][through])
                    columns = [c[~through] for c in columns]
                # the batch's memory may go meanwhile
                held.append([c.copy() for c in columns])
                n += len(columns[0])
                if n > limit:
                    columns = joined(held)
                    key = columns[0]
                    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    many = np.diff(np.append(begin, len(key)))
                    through = np.repeat(many > GROUP * GROUP, many)
                    if through.any():
                        passing = np.append(passing, key[begin[many > GROUP * GROUP]])
                        yield _rows(key[through], columns[1][through])
                    held = [[c[~through] for c in columns]]
                    n = len(held[0][0])
                    limit = max(HOLD, 2 * n)
        if held:
            yield met()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, node long")


def _rows(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch, each once."""
    order = np.lexsort((node, key))
    order = order[_new(key[order], node[order])]
    key, node = key[order], node[order]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])


class Units:
    """What a unit is: find gives row, begin, end, words and perhaps the first word's place of each; hashes gives their shingles."""

    def __init__(self, find: Callable, hashes: Callable, bands: int, rows: int):
        self.find, self.hashes, self.bands, self.rows = find, hashes, bands, rows

    def places(self):
        """Every unit; the first of a node in its task carries the node's band keys, others none."""
        find, hashes, bands, rows = self.find, self.hashes, self.bands, self.rows

        def run(batches):
            seen: set[int] = set()
            for batch in batches:
                if len(seen) > SEEN:
                    seen.clear()
                data, offsets = string_buffers(batch.column("text"))
                for i, j in blocks(offsets, SCAN):
                    part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    row, begin, end, words, *more_ = find(part, local)
                    word = more_[0] if more_ else np.zeros(len(row), np.int64)
                    points = counts((part & 0xC0) != 0x80)
                    base = points[local[row]]
                    new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
                    no = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
                    node = range_hashes(part, begin, end).astype(np.int64)
                    first = np.zeros(len(node), bool)
                    for k, x in enumerate(node.tolist()):
                        if x not in seen:
                            seen.add(x)
                            first[k] = True
                    every = {"row": row, "no": no, "begin": points[begin] - base, "end": points[end] - base, "n_words": words, "word": word, "node": node}
                    yield _placed(batch, i, every, first, hashes(part, begin[first], end[first]) if first.any() else None, bands, rows)

        return run

    def bodies(self, wanted: np.ndarray):
        """The bytes of each node that the filter of wanted ones lets pass, once a task."""
        find = self.find

        def run(batches):
            seen: set[int] = set()
            for batch in batches:
                if len(seen) > SEEN:
                    seen.clear()
                data, offsets = string_buffers(batch.column("text"))
                for i, j in blocks(offsets, SCAN):
                    part = data[offsets[i] : offsets[j]]
                    _, begin, end, *_ = find(part, offsets[i : j + 1] - offsets[i])
                    node = range_hashes(part, begin, end).astype(np.int64)
                    found = []
                    at = np.flatnonzero(passes(wanted, node))
                    for k, x in zip(at.tolist(), node[at].tolist(), strict=True):
                        if x not in seen:
                            seen.add(x)
                            found.append((x, part[begin[k] : end[k]].tobytes()))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["node", "body"])

        return run

    def expand(self):
        """A function that makes the sorted sets of a column of unit bytes."""
        hashes = self.hashes

        def run(bodies: pa.Array) -> list[np.ndarray]:
            data, offsets = string_buffers(bodies)
            out: list = []
            for i, j in blocks(offsets):
                out += sorted_sets(*hashes(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]))
            return out

        return run

    def sketches(self):
        expand = self.expand()

        def run(batches):
            for batch in batches:
                sets = expand(batch.column("body"))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int32()), pa.array([parity_sketch(x).tobytes() for x in sets], pa.binary()), batch.column("body")], ["node", "n", "sketch", "items"])

        return run


def _placed(batch: pa.RecordBatch, i: int, columns: dict[str, np.ndarray], first: np.ndarray, found, bands: int, rows: int) -> pa.RecordBatch:
    """Rows of PLACE; found has the shingles of the first ones."""
    n = len(columns["row"])
    sign, more, keys = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(0, np.int64)
    if found is not None:
        keys, sign[first], more[first] = signature_keys(*found, bands, rows)
    at = pa.array(columns["row"] + i)
    ints = [pa.array(columns[c].astype(np.int32)) for c in ("no", "begin", "end", "n_words", "word")]
    starts = pa.array(np.concatenate(([0], np.cumsum(first) * bands)).astype(np.int32))
    arrays = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), *ints, pa.array(columns["node"]), pa.array(sign), pa.array(more), pa.ListArray.from_arrays(starts, pa.array(keys.ravel()))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "no", "begin", "end", "n_words", "word", "node", "sign", "more", "keys"])


def unit_classes(spark: SparkSession, docs: DataFrame, units: Units, percent: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(places, nodes) of docs (doc_id, text).

    places: doc_id, text_hash, no, begin, end, n_words, word, node of every unit,
    in code points. nodes: node, keep, n_units, linked of every node: the first
    place of its component as keep (doc_key, doc_id, text_hash, no, begin, end), the units
    of the component, and whether it has other nodes.
    """
    scratch = Scratch(spark, label)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    scanned = scratch.keep(docs.mapInArrow(units.places(), PLACE))
    places = scanned.drop("sign", "more", "keys")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_key"), "doc_id", "text_hash", "no", "begin", "end")
    per = scratch.keep(places.groupBy("node").agg(F.min(order).alias("keep"), F.count("*").alias("n_units")))
    most = most_apart(units.bands * units.rows, percent)
    buckets = 1 + scanned.count() * units.bands // BUCKET
    groups = scratch.keep(met_keys(packed_keys(scanned, buckets), most))
    scratch.tidy()
    chosen = scratch.keep(groups.select("node").distinct())
    bodies = docs.select("text").mapInArrow(units.bodies(node_filter(chosen)), "node long, body binary").join(chosen, "node", "left_semi")
    known = scratch.keep(bodies.dropDuplicates(["node"]).mapInArrow(units.sketches(), SKETCH))
    weight = chosen.join(per.select("node", F.col("n_units").alias("weight")), "node", "left").select("node", F.coalesce("weight", F.lit(1)).alias("weight"))
    roots = linked(scratch, groups, known, percent, units.expand(), weight, inline=True)
    # only nodes with links meet by root; the others are their own class
    placed = scratch.keep(per.join(roots, "node"))
    best = placed.groupBy("root").agg(F.min("keep").alias("keep"), F.sum("n_units").alias("n_units"))
    joined = placed.select("node", "root").join(best, "root").select("node", "keep", "n_units", F.lit(True).alias("linked"))
    lone = per.join(roots.select("node"), "node", "left_anti").select("node", "keep", "n_units", F.lit(False).alias("linked"))
    return places, lone.unionByName(joined)
