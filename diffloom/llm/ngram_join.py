"""N-gram Jaccard join by parity sketches.

Every text is a set of word shingles. A set of size a can only reach the
similarity t with sets of at most a / t elements, so sizes fall into bands and
a pair meets in the band of its smaller side. Within a band the symmetric
difference of such a pair has a bound D. The hash space is cut into D + 1
pieces; each element flips bits of its own piece only, so at most D pieces
differ and the pair agrees on one piece at least: an equi-join on (band,
piece, XOR of the piece) finds it. Candidate pairs are then held against the
Hamming distance of short folded bit sketches, a lower bound of the symmetric
difference, and what is left is verified on the full sets.

Sets of one content are one node from the start, so copies never meet each
other. Per key only links to the key's smallest node are tested at first;
after the components are known, keys that still join several components are
searched in full: small components in blocks per key, large ones in one group
per component, split in blocks. Pairs that the sketches exclude leave no row.

A pair whose common pieces are all empty would be missed; small sets use
several independent cuts, which puts the chance of a miss below 1e-9 a pair.

Nulls and texts without words are empty sets and link with nothing. Rows whose
id is null keep a null component. Extra columns are ignored. Repeated ids are
separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .filters import node_filter, passes
from .shared import SEEN, Scratch, blocks, lower_ascii, mix, shingle_sets, string_buffers, table

_U = np.uint64
#: Upper sizes of bands grow by this factor.
BAND = 1.6
#: Components of this many nodes are compared as one group instead of per key.
LARGE = 16
#: Rows of a block when the nodes of a key or component are compared.
BLOCK = 256
#: Parts that the members of a large component are dealt to, so that none of its joins gathers them in one task.
SALT = 64
SKETCH = "node long, n int, sketch binary, items binary"


def band_edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges)


_EDGES = band_edges()


def difference_bound(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of sets of these sizes that are similar enough."""
    return (a + b) * (100 - percent) // (100 + percent)


def cuts(n: int) -> int:
    """Independent cuts for sets of this size."""
    return 8 if n <= 12 else 5 if n <= 20 else 4 if n <= 40 else 2 if n <= 64 else 1


def set_id(items: np.ndarray) -> int:
    """A signed 64-bit name of a set's content; 0 is the empty set."""
    if not len(items):
        return 0
    return int(mix(np.array([mix(items).sum(dtype=_U) ^ _U(len(items) * 0x9E3779B97F4A7C15 % (1 << 64))], _U)).astype(np.int64)[0]) or 1


def piece_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set: one for each non-empty piece, band and cut."""
    n, out = len(items), []
    low = -(-percent * n // 100)
    first, last = (int(np.searchsorted(_EDGES, x, "right")) - 1 for x in (max(1, low), n))
    for cut in range(cuts(n) if n <= 64 else 1):
        x = items if not cut else np.sort(mix(items + _U(cut)))
        for band in range(first, last + 1):
            small = int(_EDGES[band + 1]) - 1
            if cut and cut >= cuts(int(_EDGES[band])):
                continue
            pieces = difference_bound(small, small * 100 // percent, percent) + 1
            at = ((x >> _U(32)) * _U(pieces)) >> _U(32)
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            parity = np.bitwise_xor.reduceat(mix(x), start)
            out.append(mix(parity + mix(at[start] * _U(64) + _U(cut + 1)) + _U((band + 1) * 0x632BE59BD9B4E019 % (1 << 64))))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def parity_sketch(items: np.ndarray) -> np.ndarray:
    """Bits that each element flips; about four bits an element, a power of two, so larger sketches fold onto smaller."""
    m = 64
    while m < 4 * len(items):
        m *= 2
    return np.packbits((np.bincount((items & _U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).view(_U)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def may_link(na, nb, distance, percent: int):
    """False where sizes or the sketches' distance exclude the similarity."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (distance <= (na + nb) * (100 - percent) // (100 + percent))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = string_buffers(batch.column("text"))
    for i, j in blocks(offsets):
        part = lower_ascii(data[offsets[i] : offsets[j]])
        yield from enumerate(shingle_sets(part, offsets[i : j + 1] - offsets[i], width), i)


def _names(width: int):
    def run(batches):
        for batch in batches:
            found = [(set_id(s), len(s)) for _, s in _sets(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "text_hash", "node", "n_shingles"])

    return run


def _keys(width: int, percent: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, nodes = [], []
            if len(seen) > SEEN:
                seen.clear()
            for _, s in _sets(batch, width):
                if len(s) and (node := set_id(s)) not in seen:
                    seen.add(node)
                    keys.append(piece_keys(s, percent))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return run


def _sketches(width: int, wanted: np.ndarray, pack=None):
    """The sets that the filter of wanted ones lets pass, each once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            sets = {set_id(s): s for _, s in _sets(batch, width)}
            names = np.fromiter(sets, np.int64, len(sets))
            found = {node: sets[node] for node in names[passes(wanted, names)].tolist() if node not in seen}
            seen.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([len(s) for s in found.values()], pa.int32()), pa.array([parity_sketch(s).tobytes() for s in found.values()], pa.binary()), pa.array([(pack or packed)(s) for s in found.values()], pa.binary())],
                ["node", "n", "sketch", "items"],
            )

    return run


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Hamming distances of two columns of sketches, the larger one folded."""
    (da, oa), (db, ob) = (string_buffers(x) for x in (a, b))
    la, lb = np.diff(oa), np.diff(ob)
    out = np.zeros(len(la), np.int64)
    for size in np.unique(la * (1 << 32) + lb).tolist():
        x, y = size >> 32, size & 0xFFFFFFFF
        for rows in np.array_split(at := np.flatnonzero((la == x) & (lb == y)), 1 + len(at) * max(x, y) // (1 << 24)):
            m, n = (d[o[rows][:, None] + np.arange(w)].view(_U) for d, o, w in ((da, oa, x), (db, ob, y)))
            while m.shape[1] > n.shape[1]:
                m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
            while n.shape[1] > m.shape[1]:
                n = n[:, : n.shape[1] // 2] ^ n[:, n.shape[1] // 2 :]
            out[rows] = np.bitwise_count(m ^ n).sum(axis=1)
    return out


def _near(percent: int):
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            yield batch.select(["u", "v"]).filter(pa.array(may_link(na, nb, distances(batch.column("sa"), batch.column("sb")), percent)))

    return run


def packed(items: np.ndarray) -> bytes:
    """The first 48 bits of sorted hashes; see doubtful."""
    return (items >> _U(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def as_sets(items: pa.Array) -> list[np.ndarray]:
    """Sets that are stored packed, without merging elements that have become equal."""
    out = []
    for x in items:
        six = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
        eight = np.zeros((len(six), 8), np.uint8)
        eight[:, 2:] = six
        out.append(eight.view(">u8").ravel().astype(_U))
    return out


def whole_sets(items: pa.Array) -> list[np.ndarray]:
    """Sets that are stored with 64 bits an element."""
    return [np.frombuffer(x.as_buffer(), _U) for x in items]


def doubtful(a: np.ndarray, b: np.ndarray, both: int, percent: int) -> bool:
    """Whether elements that are equal in 48 bits only could change what is decided: more than this many are so once in a billion pairs at most, of any size."""
    many = 2 + 3 * (len(a) + len(b)) ** 2 // (1 << 48)
    return abs(100 * both - percent * (len(a) + len(b) - both)) <= (100 + percent) * many


def _each(expand, items: pa.Array) -> list[np.ndarray]:
    """The set of each row; equal items are expanded once."""
    known = items.dictionary_encode()
    sets = expand(known.dictionary)
    return [sets[k] for k in known.indices.to_pylist()]


def _once(a: np.ndarray) -> np.ndarray:
    """A sorted array without its repeats."""
    new = a[1:] != a[:-1]
    return a if new.all() else a[np.concatenate(([True], new))]


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays share, repeats counted once."""
    every = np.concatenate((_once(a), _once(b)))
    every.sort()
    return int(np.count_nonzero(every[1:] == every[:-1]))


def _similar(percent: int, expand, cut: bool):
    """Pairs that link as sure ones; with cut hashes also those that are doubtful, as not sure."""

    def run(batches):
        for batch in batches:
            keep, sure = [], []
            for a, b in zip(_each(expand, batch.column("ia")), _each(expand, batch.column("ib")), strict=True):
                both = in_both(a, b)
                doubt = cut and doubtful(a, b, both, percent)
                keep.append(doubt or 100 * both >= percent * (len(a) + len(b) - both))
                sure.append(not doubt)
            yield batch.select(["u", "v"]).append_column("sure", pa.array(sure, pa.bool_())).filter(pa.array(keep, pa.bool_()))

    return run


def _hits(n: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left and right rows of different roots whose sizes and sketches don't exclude a link; unequal sketches are folded. Where both sides are the same rows, each pair comes once."""
    width, same = np.array([len(x) for x in sketches]), np.array_equal(left, right)
    of = {w: (left[width[left] == w], right[width[right] == w]) for w in np.unique(width).tolist()}
    for w, (some, _) in of.items():
        # similar sets have sketches of equal widths or of neighbouring ones
        for v in (w, 2 * w) if same else (w // 2, w, 2 * w):
            rows, within = of[v][1] if v in of else (), same and v == w
            if not len(some) or len(rows) <= within:
                continue
            other = np.stack([fold(sketches[x], min(v, w)) for x in rows])
            step = max(1, (1 << 20) // other.size)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                own = other[i : i + step] if within else np.stack([fold(sketches[x], min(v, w)) for x in part])
                far = np.bitwise_count(own[:, None] ^ other).sum(axis=2, dtype=np.int64)
                near = may_link(n[part][:, None], n[rows], far, percent) & (root[part][:, None] != root[rows])
                k, j = np.nonzero(near & (part[:, None] < rows) if within else near)
                yield part[k], rows[j]


def _block_pairs(percent: int, expand=None):
    """Pairs between the two sides of a block whose sketches don't exclude a link; side 0 stands on both sides.

    With expand, pairs are verified here on the column items, and only as many
    links of roots are given as join what the block's links join.
    """

    def run(t: pa.Table) -> pa.Table:
        node, root, n, side = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "root", "n", "side"))
        sketches = [np.frombuffer(x.as_buffer(), _U) for c in t.column("sketch").chunks for x in c]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero((side == 0) | (side == 2))
        us, vs, sets, top = [], [], None, root.copy()
        for ks, js in _hits(n, root, sketches, left, right, percent):
            if expand is None:
                us.append(np.minimum(node[ks], node[js]))
                vs.append(np.maximum(node[ks], node[js]))
                continue
            for k, j in zip(ks.tolist(), js.tolist(), strict=True):
                if top[j] == top[k]:
                    continue
                sets = expand(t.column("items").combine_chunks()) if sets is None else sets
                both = in_both(sets[k], sets[j])
                if 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                    us.append([min(root[k], root[j])])
                    vs.append([max(root[k], root[j])])
                    top[top == top[j]] = top[k]
        return pa.table({"u": pa.array(np.concatenate(us) if us else [], pa.int64()), "v": pa.array(np.concatenate(vs) if vs else [], pa.int64())})

    return run


def _dealt(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows (group, node, root, n, sketch, part, of) to the pairs of blocks (i <= j) of their group that hold them."""
    pair = F.expr("transform(sequence(0, of - 1), x -> struct(least(part, x) AS i, greatest(part, x) AS j, IF(x = part, 0, IF(part < x, 1, 2)) AS side))")
    return rows.withColumn("at", F.explode(pair)).drop("part", "of").select(*group, "at.i", "at.j", "at.side", *[c for c in ("node", "root", "n", "sketch", "items") if c in rows.columns])


def _verified(pairs: DataFrame, known: DataFrame, scratch: Scratch, percent: int, expand, exact=None) -> DataFrame:
    """The pairs (u, v) that link: first by sketches, the rest by the full sets, and those that cut hashes leave open by whole ones."""

    def both(p: DataFrame, columns: dict[str, str], sets: DataFrame = known) -> DataFrame:
        for end, tag in (("u", "a"), ("v", "b")):
            p = p.join(sets.select(F.col("node").alias(end), *[F.col(c).alias(s + tag) for c, s in columns.items()]), end)
        return p

    near = scratch.keep(both(pairs, {"n": "n", "sketch": "s"}).mapInArrow(_near(percent), "u long, v long"))
    told = scratch.keep(both(near, {"items": "i"}).mapInArrow(_similar(percent, expand, exact is not None), "u long, v long, sure boolean"))
    links, open_ = told.where("sure").select("u", "v"), told.where("NOT sure").select("u", "v")
    if exact is None or open_.isEmpty():
        return links
    sets = scratch.keep(exact(scratch.keep(open_.select(F.explode(F.array("u", "v")).alias("node")).distinct())))
    late = both(open_, {"items": "i"}, sets).mapInArrow(_similar(percent, whole_sets, False), "u long, v long, sure boolean")
    return scratch.keep(links.unionByName(late.select("u", "v")))


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows (key, node) of keys that several nodes have."""
    by_key = "OVER (PARTITION BY key ORDER BY node)"
    beside = keys.selectExpr("key", "node", f"lag(node) {by_key} AS before", f"lead(node) {by_key} AS after")
    # of a repeated node the last row counts before a larger one, the first after a smaller one
    return beside.where("before < node OR after > node").select("key", "node").distinct()


def linked(scratch: Scratch, groups: DataFrame, known: DataFrame, percent: int = 80, expand=as_sets, weight: DataFrame | None = None, inline: bool = False, exact=None) -> DataFrame:
    """node, root of all nodes that link over the keys they share.

    groups: key, node, from shared_keys. known: node, n, sketch, items of those nodes. Both are written tables.
    weight: node, weight; a key's nodes are first held against its heaviest one, or the smallest if there are no weights.
    expand turns a column of items into sorted arrays of hashes.
    inline: blocks verify their pairs themselves; for items that are small enough to go with every block.
    exact: gives node, items with whole hashes for nodes (node), if those of known are cut; pairs that cut hashes might decide wrongly are decided by these.
    """
    if weight is None:
        centre = groups.groupBy("key").agg(F.min("node").alias("u"))
    else:
        centre = groups.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("u"))
    star = groups.join(centre, "key").where("u <> node").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
    links = _verified(star, known, scratch, percent, expand, exact)
    roots = components(scratch, links)

    held = groups.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("g")).where("low < high AND g > 2").select("key")
    salt = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALT)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    opened = scratch.keep(held.join(mixed, "key").select("key", "node", "root", salt))
    if opened.isEmpty():
        scratch.drop(groups, known, opened)
        return roots
    size = roots.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") >= LARGE)
    large = size.join(opened.groupBy("root").agg(F.lit(True).alias("large")), "root").select("root", "large", salts)
    open_rows = scratch.keep(opened.join(large, ["root", "salt"], "left").select("key", "node", "root", "salt", F.coalesce("large", F.lit(False)).alias("large")))
    sketch = known if inline else known.select("node", "n", "sketch")
    in_block = _block_pairs(percent, expand if inline else None)
    # the two halves are jobs of their own, and none where there is nothing to compare: the driver holds one's plan at a time
    found, done = [], [groups, known, opened, open_rows]

    # nodes of small components: compared per key, once for each distinct set of nodes
    small = open_rows.where("NOT large")
    if not small.isEmpty():
        sign = small.groupBy("key").agg(F.count("*").alias("g"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 7))").alias("y"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        once = sign.groupBy("g", "x", "y").agg(F.min("key").alias("key"))
        parts = F.ceil(F.col("g") / BLOCK).cast("int")
        rows = small.join(once.select("key", "g"), "key").join(sketch, "node").withColumn("of", parts).withColumn("part", F.expr("CAST(pmod(xxhash64(node, 3), of) AS INT)"))
        found.append(scratch.keep(_dealt(rows, ["key"]).groupBy("key", "i", "j").applyInArrow(in_block, "u long, v long")))

    # members of a large component against every node that shares a key with one of them
    anchors = open_rows.where("large").select("key", F.col("root").alias("anchor")).distinct()
    if not open_rows.where("large").isEmpty():
        guests = scratch.keep(open_rows.join(anchors, "key").where("root <> anchor").select("anchor", "node", "root", "salt").distinct())
        done.append(guests)
        if not guests.isEmpty():
            visited = guests.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
            hosts = roots.select(F.col("root").alias("anchor"), "node", "root", salt).join(visited.select("anchor", salts), ["anchor", "salt"], "left_semi")
            count = hosts.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("h")).join(visited, "anchor")
            counted = scratch.keep(count.select("anchor", "h", "k", salts))
            slot = "CAST(pmod(xxhash64(node, 3), {0}) AS INT)"
            dealt_hosts = hosts.join(counted, ["anchor", "salt"]).selectExpr("anchor", "node", "root", f"{slot.format('h')} AS i", "explode(sequence(0, k - 1)) AS j", "1 AS side")
            dealt_guests = guests.join(counted, ["anchor", "salt"]).selectExpr("anchor", "node", "root", "explode(sequence(0, h - 1)) AS i", f"{slot.format('k')} AS j", "2 AS side")
            outer = dealt_hosts.unionByName(dealt_guests).join(sketch, "node").groupBy("anchor", "i", "j").applyInArrow(in_block, "u long, v long")
            found.append(scratch.keep(outer))
            done.append(counted)

    done += found
    found = [x for x in found if not x.isEmpty()]
    if not found:
        scratch.drop(*done)
        return roots
    either = functools.reduce(DataFrame.unionByName, found).distinct()
    more = scratch.keep(either if inline else either.join(star, ["u", "v"], "left_anti"))
    done.append(more)
    late = more if inline else _verified(more, known, scratch, percent, expand, exact)
    if late.agg(F.count("*")).first()[0]:
        # the late links join components: contract to their roots, then rename
        of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        ends = late.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
        over = components(scratch, ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = scratch.keep(old.unionByName(over.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))))
    scratch.drop(*done)
    return roots


def jaccard_links(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(membership, roots) of docs (doc_id, text).

    membership: doc_id, node, n_shingles, a row per input row; documents of one
    node have one set. roots: node, root for nodes with links.
    """
    scratch = Scratch(spark, "ngram")
    docs = scratch.few(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
    names = scratch.keep(docs.mapInArrow(_names(width), "doc_id long, text_hash long, node long, n_shingles long"))
    groups = scratch.keep(shared_keys(docs.select("text").mapInArrow(_keys(width, percent), "key long, node long")))
    # the sets are made again where the texts are, so that only those that share a key are moved
    chosen = scratch.keep(groups.select("node").distinct())
    known = scratch.keep(docs.select("text").mapInArrow(_sketches(width, node_filter(chosen)), SKETCH).join(chosen, "node", "left_semi").dropDuplicates(["node"]))

    def exact(nodes: DataFrame) -> DataFrame:
        made = docs.select("text").mapInArrow(_sketches(width, node_filter(nodes), np.ndarray.tobytes), SKETCH)
        return made.join(nodes, "node", "left_semi").select("node", "items").dropDuplicates(["node"])

    return names, linked(scratch, groups, known, percent, exact=exact)


def ngram_components(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_copies (rows with the same set), and with hashes text_hash (xxhash64 of the text)."""
    names, roots = jaccard_links(spark, docs, width, percent)
    names = names if hashes else names.drop("text_hash")
    least = names.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    placed = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = placed.join(lowest, "root").select("node", "component_id", "n_copies")
    full = names.join(of_node, "node", "left")
    return full.select("doc_id", *(["text_hash"] if hashes else []), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark, table(spark, sf_dir, "documents"))


#: The same by joining all sets on their shingles, and following all links.
OP1_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT rid, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS content FROM s GROUP BY rid),
c AS (SELECT rid, n, min(rid) OVER (PARTITION BY content) AS node, count(*) OVER (PARTITION BY content) AS n_copies FROM n),
o AS (SELECT s.rid, shingle FROM s JOIN c USING (rid) WHERE rid = node),
p AS (SELECT a.rid AS u, b.rid AS v, count(*) AS shared FROM o a JOIN o b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN c x ON x.rid = u JOIN c y ON y.rid = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(a, z) AS (SELECT rid, rid FROM c WHERE rid = node UNION SELECT a, v FROM r JOIN l ON z = u),
least AS (SELECT node, min(doc_id) AS least FROM c JOIN d USING (rid) GROUP BY node),
m AS (SELECT a AS node, min(least) AS component_id FROM r JOIN least ON z = node GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END AS component_id, coalesce(n_copies, 1) AS n_copies FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (node)
"""
