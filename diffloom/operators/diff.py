"""Line diff of two texts, and texts rebuilt from edits.

Lines end at line feeds; a last line without one differs from the same line
with one. The number of deleted and inserted lines is the least possible:
equal beginnings and ends are cut off, lines that only one side has are edits
in any case and go next, and what is left is solved greedily where few edits
do, else by searching from both ends for a point in the middle that a shortest
edit path runs through, on either side of which the same is done again. The
searches of one step run over all diagonals together. Memory is linear in the
lines of a file; time grows with the product of lines and edits at worst.
Between two kept lines deletions come before insertions.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edits up to which paths are kept step by step, and lines of an output batch.
GREEDY, BATCH_LINES = 24, 1 << 15
#: Where no path has come to yet.
_NONE = -(1 << 40)


def lines_of(text: str | None) -> list[str]:
    """Lines with their line feeds."""
    parts = (text or "").split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def greedy(a: list, b: list, most: int) -> list[tuple[int, int]] | None:
    """Pairs of equal items of a shortest edit path, or None if it has more than so many edits."""
    n, m = len(a), len(b)
    reach, steps = {1: 0}, []
    for d in range(most + 1):
        steps.append(reach)
        now = {}
        for k in range(-d, d + 1, 2):
            down, right = reach.get(k + 1, _NONE), reach.get(k - 1, _NONE) + 1
            x = max(down, right)
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            now[k] = x
            if k == n - m and x >= n:
                return _walked(steps, n, m)
        reach = now
    return None


def _walked(steps: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(steps) - 1, -1, -1):
        before, k = steps[d], x - y
        down, right = before.get(k + 1, _NONE), before.get(k - 1, _NONE) + 1
        begin = max(down, right)
        while x > begin:
            x, y = x - 1, y - 1
            out.append((x, y))
        if d:
            x, y = (x, y - 1) if down >= right else (x - 1, y)
    return out[::-1]


def _run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How many items from a[x] and b[y] on are equal."""
    most, size, done = min(len(a) - x, len(b) - y), 64, 0
    while done < most:
        size = min(size, most - done)
        unequal = np.flatnonzero(a[x + done : x + done + size] != b[y + done : y + done + size])
        if len(unequal):
            return done + int(unequal[0])
        done, size = done + size, 2 * size
    return done


def _step(reach: np.ndarray, a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Moves all diagonals of a search on by one edit; reach has the furthest place in a by diagonal + len(b) + 1. Gives the diagonals."""
    n, m = len(a), len(b)
    k = np.arange(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2)
    at = k + m + 1
    x = np.minimum(np.maximum(reach[at + 1], reach[at - 1] + 1), np.minimum(n, m + k))
    live = np.flatnonzero((x < n) & (x - k < m))
    while len(live) > 8:
        live = live[a[x[live]] == b[x[live] - k[live]]]
        x[live] += 1
        live = live[(x[live] < n) & (x[live] - k[live] < m)]
    for i in live.tolist():
        x[i] += _run(a, b, int(x[i]), int(x[i] - k[i]))
    reach[at] = x
    return k


def middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point that a shortest edit path runs through, with half of its edits on either side."""
    n, m = len(a), len(b)
    back_a, back_b = a[::-1], b[::-1]
    fore, back = np.full(n + m + 3, _NONE), np.full(n + m + 3, _NONE)
    fore[m + 2] = back[m + 2] = 0
    for d in range((n + m + 1) // 2 + 1):
        for reach, other, x, y, first in ((fore, back, a, b, True), (back, fore, back_a, back_b, False)):
            k = _step(reach, x, y, d)
            # paths of the other search meet these after an odd number of edits, or an even one for the second
            if (n - m) % 2 == first:
                met = np.flatnonzero(reach[k + m + 1] + other[np.clip(n - m - k + m + 1, 0, n + m + 2)] >= n)
                if len(met):
                    u = int(reach[k[met[0]] + m + 1])
                    v = u - int(k[met[0]])
                    return (u, v) if first else (n - u, m - v)
    raise AssertionError("searches from both ends meet")


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many items are equal at the beginning, and how many of the others at the end."""
    head = _run(a, b, 0, 0)
    return head, _run(a[head:][::-1], b[head:][::-1], 0, 0)


def matches(before: list[str], after: list[str]) -> list[tuple[int, int]]:
    """Places of the lines that are kept, in order; all others are edits, of which there can't be fewer."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in lines], np.int64) for lines in (before, after))
    out: list[tuple[int, int]] = []
    head, tail = _ends(a, b)
    out += [(k, k) for k in range(head)]
    in_a, in_b = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    in_a[a[head : len(a) - tail]] = in_b[b[head : len(b) - tail]] = True
    at_a, at_b = head + np.flatnonzero(in_b[a[head : len(a) - tail]]), head + np.flatnonzero(in_a[b[head : len(b) - tail]])
    a_in, b_in = a[at_a], b[at_b]
    todo = [(0, len(a_in), 0, len(b_in))]
    while todo:
        i, j, u, v = todo.pop()
        x, y = a_in[i:j], b_in[u:v]
        if not len(x) or not len(y):
            continue
        first, last = _ends(x, y)
        out += [(at_a[i + k], at_b[u + k]) for k in range(first)] + [(at_a[j - 1 - k], at_b[v - 1 - k]) for k in range(last)]
        i, j, u, v = i + first, j - last, u + first, v - last
        x, y = a_in[i:j], b_in[u:v]
        if not len(x) or not len(y):
            continue
        found = greedy(x.tolist(), y.tolist(), GREEDY)
        if found is not None:
            out += [(at_a[i + p], at_b[u + q]) for p, q in found]
        else:
            p, q = middle(x, y)
            todo += [(i, i + p, u, u + q), (i + p, j, u + q, v)]
    out += [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail)]
    return sorted((int(p), int(q)) for p, q in out)


def edits(before: str | None, after: str | None):
    """Yields (kind, line) in order: keep, before (deleted) and after (inserted) lines."""
    a, b = lines_of(before), lines_of(after)
    i = j = 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        yield from (("before", x) for x in a[i:p])
        yield from (("after", x) for x in b[j:q])
        if p < len(a):
            yield "keep", a[p]
        i, j = p + 1, q + 1


def diff_lines(pairs: DataFrame) -> DataFrame:
    """doc_id, path, line_no (place in the script, from 1), kind, content, no_newline of pairs (doc_id, path, before, after); null texts are empty."""
    names = ["doc_id", "path", "line_no", "kind", "content", "no_newline"]

    def run(batches):
        for batch in batches:
            columns = [[] for _ in names]

            def made(columns):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.bool_()], strict=True)], names)

            for i in range(len(batch)):
                doc, path, before, after = (c[i].as_py() for c in batch.columns)
                for n, (kind, line) in enumerate(edits(before, after)):
                    open_end = not line.endswith("\n")
                    for column, value in zip(columns, (doc, path, n + 1, kind, line if open_end else line[:-1], open_end), strict=True):
                        column.append(value)
                    if len(columns[0]) >= BATCH_LINES:
                        yield made(columns)
                        columns = [[] for _ in names]
            yield made(columns)

    kind = lambda c: pairs.schema[c].dataType.simpleString()
    return pairs.select("doc_id", "path", "before", "after").mapInArrow(run, f"doc_id {kind('doc_id')}, path {kind('path')}, line_no long, kind string, content string, no_newline boolean")


def counted(script: DataFrame) -> DataFrame:
    """doc_id and the numbers of kept, deleted and inserted lines."""
    n = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    return script.groupBy("doc_id").agg(n("keep", "n_kept"), n("before", "n_deleted"), n("after", "n_inserted"))


def applied(before: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, text: the after text of before (doc_id, text) and the changed lines of its hunks.

    lines: doc_id, side, line, hunk_no, ordinal, content, no_newline, in the
    coordinates of patches. A deleted line goes; an inserted one comes before
    all lines with its number or a higher one once kept lines are counted anew.
    """
    parts = F.split("text", "(?<=\n)")
    old = before.select("doc_id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("p", "raw")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "raw")
    gone = lines.where("side = 'before'").select("doc_id", "line")
    kept = old.join(gone, ["doc_id", "line"], "left_anti")
    new = lines.where("side = 'after'").select("doc_id", "line", F.concat("content", F.when(F.col("no_newline"), "").otherwise("\n")).alias("raw"))
    # kept lines take the numbers of the after text that inserted ones leave free
    ranks = kept.selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r", "raw")
    free = new.selectExpr("doc_id", "line", "line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS ahead", "raw")
    # an inserted line has so many kept lines ahead of it
    both = ranks.selectExpr("doc_id", "r AS ahead", "0L AS line", "raw").unionByName(free)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ahead", "line", "raw"))), lambda x: x["raw"]), "")
    return before.select("doc_id").join(both.groupBy("doc_id").agg(body.alias("text")), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
