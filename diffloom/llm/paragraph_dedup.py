"""Substring dedup: passages that repeat, as paragraphs and as runs of words.

A paragraph is a line. One of more than LONG words is cut further, at ends of
sentences that its own words choose: after a word that ends a sentence, if the
word's hash is divisible by CUT and at least LEAST words stand before it. Pieces
of fewer than LEAST words are no units. Two paragraphs link when the sets of
their lower-cased five-word shingles have a Jaccard similarity of PERCENT or
more, found by MinHash banding; all but the first of a component are to be
removed. See near_units for ids, nulls and ties.

A passage that stands among other prose is no paragraph. So windows of words
are held against each other too, by equality of their lower-cased words. Edges
are words whose hash of GRAM words is the least of some SPREAD that follow each
other: the words themselves tell where they are, so a passage has the same
edges wherever it stands, also across lines and without punctuation. A window
begins at an edge and ends at the first edge LEAST or more words on. A run of
words of 2 * SPREAD + GRAM + LEAST - 2 or more holds a window, and of
3 * SPREAD + GRAM + LEAST - 3 or more one that its other places have too.
A window's first place is kept, others are to be removed; of a place that
overlaps its first one, the rest is.

What overlaps or has no word between it is joined to one passage. At the ends
of a passage the words before its first edge and after its last one are left,
unless a paragraph holds them.

Documents without text have no passages; those whose id is null come last;
rows of one id and one text are one document. Extra columns are ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import node_filter, passes
from .near_units import SCAN, Units, grams, unit_classes
from .shared import _K, Scratch, blocks, counts, lower_ascii, mix, range_hashes, string_buffers, table, word_bounds

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 14, 4
LEAST, LONG, CUT = 20, 120, 3
#: Words of a hash that decides on edges, and hashes of which one is an edge.
GRAM, SPREAD = 3, 8
PLACE = "text_hash long, begin int, end int, word int, n_words int, key long"
#: Stands for a null id, behind all others.
LAST = (1 << 63) - 1


def find_paragraphs(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    row = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[starts]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(starts)))
    a, z = [begin[size <= LONG]], [(begin + size)[size <= LONG]]
    for b, n in zip(begin[size > LONG], size[size > LONG], strict=True):
        stop = np.isin(data[ends[b : b + n] - 1], np.frombuffer(b".!?", np.uint8))
        at = np.flatnonzero(stop)
        at = at[range_hashes(data[starts[b] : ends[b + n - 1]], starts[b : b + n][at] - starts[b], ends[b : b + n][at] - starts[b]) % np.uint64(CUT) == 0] + 1
        cuts, last = [0], 0
        for x in at.tolist():
            if x - last >= LEAST:
                cuts.append(x)
                last = x
        if cuts[-1] != n:
            cuts.append(n)
        a.append(b + np.array(cuts[:-1]))
        z.append(b + np.array(cuts[1:]))
    a, z = np.concatenate(a), np.concatenate(z)
    order = np.argsort(a, kind="stable")
    a, z = a[order], z[order]
    long = z - a >= LEAST
    a, z = a[long], z[long]
    return row[a], starts[a], ends[z - 1], z - a, a - first[row[a]]


def paragraph_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    low = lower_ascii(data)
    # units may touch, as where bodies are held one behind the other: no word reaches over an end
    starts, ends, _ = word_bounds(low, np.unique(np.concatenate(([0, len(low)], begin, end))))
    words = range_hashes(low, starts, ends)
    return grams(words, np.searchsorted(starts, begin), np.searchsorted(ends, end, "right"), SHINGLE)


PARAGRAPHS = Units(find_paragraphs, paragraph_hashes, BANDS, ROWS)


def edges(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the words that are edges, from the words' hashes and rows."""
    reach = SPREAD + GRAM - 1
    if len(words) < reach:
        return np.zeros(0, np.int64)
    n = len(words) - GRAM + 1
    gram = mix(sum((words[k : k + n] * _K[k] for k in range(GRAM)), np.zeros(n, np.uint64)))
    starts = np.flatnonzero(row[: len(words) - reach + 1] == row[reach - 1 :])
    # of equal hashes the last one
    least = SPREAD - 1 - np.argmin(np.lib.stride_tricks.sliding_window_view(gram, SPREAD)[starts][:, ::-1], axis=1)
    return np.unique(starts + least)


def find_windows(data: np.ndarray, offsets: np.ndarray):
    """Row, first and last byte, first word's place, words and key of each window."""
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    words = range_hashes(low, starts, ends)
    edge = edges(words, row)
    k = np.searchsorted(edge, edge + LEAST)
    a, k = edge[k < len(edge)], k[k < len(edge)]
    z = edge[k]
    inside = row[a] == row[z] if len(a) else np.zeros(0, bool)
    a, z = a[inside], z[inside]
    return row[a], starts[a], ends[z - 1], a - first[row[a]], z - a, range_hashes(words, a, z).astype(np.int64)


def _windows(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The windows of a batch of documents, in code points; with a filter only those that it lets pass."""
    data, offsets = string_buffers(batch.column("text"))
    found = []
    for i, j in blocks(offsets, SCAN):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        row, begin, end, word, n, key = find_windows(part, local)
        if wanted is not None:
            some = passes(wanted, key)
            row, begin, end, word, n, key = (x[some] for x in (row, begin, end, word, n, key))
        points = counts((part & 0xC0) != 0x80)
        base = points[local[row]]
        found.append((row + i, points[begin] - base, points[end] - base, word, n, key))
    names = ("row", "begin", "end", "word", "n_words", "key")
    return {c: np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k, c in enumerate(names)}


def _place_columns(found: dict[str, np.ndarray], batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column("text_hash").take(pa.array(found["row"])), *(pa.array(found[c].astype(np.int32)) for c in ("begin", "end", "word", "n_words")), pa.array(found["key"])]


def first_places(docs: DataFrame) -> DataFrame:
    """key, n_units, keep (the first place) of the windows that stand at several places."""

    def run(batches):
        for batch in batches:
            # a window that is frequent in the batch goes on as one row
            found = _windows(batch)
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()[found["row"]]
            hashes = batch.column("text_hash").to_numpy()[found["row"]]
            order = np.lexsort((found["begin"], hashes, ids, found["key"]))
            sorted_key = found["key"][order]
            new = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(order) else order
            one = {c: x[order[new]] for c, x in found.items()}
            many = np.diff(np.append(new, len(order)))
            missing = batch.column("doc_id").is_null().take(pa.array(one["row"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order[new]]), missing, *_place_columns(one, batch), pa.array(many.astype(np.int64))], ["doc_key", "missing", "text_hash", "begin", "end", "word", "n_words", "key", "n"])

    found = docs.mapInArrow(run, f"doc_key long, missing boolean, {PLACE}, n long")
    place = "struct(doc_key, missing, text_hash, begin, end, word + n_words AS stop)"
    return found.groupBy("key").agg(F.expr(f"min({place}) AS keep"), F.sum("n").alias("n_units")).where("n_units > 1")


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The windows that stand at several places, with keep, the first place of each."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    firsts = scratch.keep(first_places(docs))
    scratch.tidy()
    wanted = node_filter(firsts.select(F.col("key").alias("node")))

    def run(batches):
        for batch in batches:
            found = _windows(batch, wanted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(found["row"])), *_place_columns(found, batch)], ["doc_id", "text_hash", "begin", "end", "word", "n_words", "key"])

    return docs.mapInArrow(run, f"doc_id long, {PLACE}").join(firsts, "key").drop("key")


def repeated_paragraphs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Passages that repeat: doc_id, text_hash, no (in its document), begin, end (code points), n_words, class_doc_id and class_begin (where its first part stands first), n_units (most places of a part), removed.

    Parts to be removed and first places are joined separately; they may overlap.
    """
    places, classes = unit_classes(spark, docs, PARAGRAPHS, PERCENT, "paragraphs")
    columns = ["doc_id", "text_hash", "begin", "end", "word", "word + n_words AS stop", "{0} AS class_doc_id", "keep.begin AS class_begin", "n_units"]
    of_unit, of_window = ([c.format(x) for c in columns] for x in ("keep.doc_id", "IF(keep.missing, NULL, keep.doc_key)"))
    same = "doc_id <=> {0} AND text_hash = keep.text_hash"
    of_first = same.format("IF(keep.missing, NULL, keep.doc_key)")
    same = same.format("keep.doc_id")
    units = places.join(classes.where("n_units > 1").drop("linked"), "node").selectExpr(*of_unit, f"NOT ({same} AND begin = keep.begin) AS removed")
    windows = repeated_windows(docs, Scratch(spark, "windows")).selectExpr(*of_window, f"NOT ({of_first} AND begin = keep.begin) AS removed", f"removed AND {of_first} AND begin < keep.end AS cut", "keep.end AS kept_end", "keep.stop AS kept_stop")
    # of a place that overlaps its first one, what stands behind that
    cut = windows.withColumns({"begin": F.expr("IF(cut, kept_end, begin)"), "word": F.expr("IF(cut, kept_stop, word)")}).where("begin < end AND word < stop").drop("cut", "kept_end", "kept_stop")
    of = "PARTITION BY doc_id, text_hash, removed ORDER BY begin, end, class_doc_id, class_begin"
    ahead = units.unionByName(cut).selectExpr("*", f"max(stop) OVER ({of} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached")
    runs = ahead.selectExpr("*", f"sum(IF(reached >= word, 0, 1)) OVER ({of} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run")
    first = lambda c: F.min_by(c, F.struct("begin", "end", "class_doc_id", "class_begin")).alias(c)
    joined = runs.groupBy("doc_id", "text_hash", "removed", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), (F.max("stop") - F.min("word")).alias("n_words"), first("class_doc_id"), first("class_begin"), F.max("n_units").alias("n_units"))
    no = "row_number() OVER (PARTITION BY doc_id, text_hash ORDER BY begin, end, removed) - 1 AS no"
    return joined.selectExpr("doc_id", "text_hash", no, "begin", "end", "n_words", "class_doc_id", "class_begin", "n_units", "removed")


def remove_paragraphs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text without the paragraphs to be removed, for documents that lose any."""
    gone = repeated_paragraphs(spark, docs).where("removed").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("gone"))
    start = "named_struct('at', 0, 'parts', CAST(array() AS array<string>))"
    step = "(a, s) -> named_struct('at', s.end, 'parts', array_append(a.parts, substr(text, a.at + 1, s.begin - a.at)))"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(gone.withColumnsRenamed({"doc_id": "d"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("text_hash"))).selectExpr("doc_id", f"aggregate(gone, {start}, {step}, a -> concat(array_join(a.parts, ''), substr(text, a.at + 1))) AS text")


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark, table(spark, sf_dir, "documents"))
