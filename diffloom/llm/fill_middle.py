"""Fill-in-middle transformation: whole batches of texts are cut by one numpy kernel on Arrow's UTF-8 buffers.

A unit is a run of letters A-Z and a-z, or any other code point alone. Bytes
are classed by a table; a mask of adjacent bytes tells where units begin, texts
begin one anew, and the running count of beginnings, less what stands before a
text, numbers its units. A search in that count gives the bytes of all cuts of
a batch at once. Cuts and form come from a digest of seed and id, so that runs
agree wherever a row is worked on.

A null text counts as empty and stays plain, as a text does that holds a mark
already. A null id is digested as an empty one; repeated ids are cut at the
same hashes. There are no ties. A text of any length is cut whole, and batches
are worked on in slices of a few MB, so a task holds a slice or its longest
text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, string_buffers, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts that can be cut, so many are; of those, so many begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = "1"
#: Bytes of text whose arrays a task holds at a time.
SLICE = 4 << 20

OTHER, LETTER, INSIDE = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[128:192] = INSIDE  # of a code point that began before


def draws(ids: list, seed: str = SEED) -> np.ndarray:
    """Four numbers below 2**32 for each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).digest()[:16] for x in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def unit_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many units of the batch, and how many code points, begin up to each byte."""
    kind = _CLASS[data]
    points = kind != INSIDE
    begins = points.copy()
    letter = kind == LETTER
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.cumsum(begins, dtype=np.int32), np.cumsum(points, dtype=np.int32)


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)])) if len(data) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, percent: int = CUT, suffix_first: int = SUFFIX_FIRST):
    """Of each text: units, whether it is cut, whether its suffix comes first, and the bytes and code points up to both cuts."""
    units, points = unit_counts(data, offsets)
    upto = lambda counts, at: np.concatenate(([0], counts))[at].astype(np.int64)
    before = upto(units, offsets)
    n = np.diff(before)
    chosen = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # the byte that begins a unit; beyond the last one that is where the text ends
    at = np.searchsorted(units, before[:-1, None] + chosen + 1)
    chars = upto(points, at) - upto(points, offsets[:-1])[:, None]
    plain = (n == 0) | marked(data, offsets) | (h[:, 2] % 100 >= percent)
    return n, ~plain, h[:, 3] % 100 < suffix_first, at, chars


def transformed(ids: list, texts: pa.Array, seed: str = SEED, percent: int = CUT, suffix_first: int = SUFFIX_FIRST) -> list:
    """Columns n, form, prefix_chars, middle_chars, output of a batch."""
    data, offsets = string_buffers(texts)
    n, cuts, first, at, chars = cut(data, offsets, draws(ids, seed), percent, suffix_first)
    raw, p, s, m = data.tobytes(), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for a, b, c, d, yes, spm in zip(offsets[:-1].tolist(), at[:, 0].tolist(), at[:, 1].tolist(), offsets[1:].tolist(), cuts.tolist(), first.tolist(), strict=True):
        if not yes:
            out.append(raw[a:d])
        elif spm:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    form = np.where(cuts, np.where(first, "spm", "psm"), "plain")
    return [
        pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(chars[:, 0], pa.int64(), mask=~cuts), pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=~cuts),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


def fill_in_middle(docs: DataFrame, seed: str = SEED, percent: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i, j in blocks(string_buffers(texts)[1], SLICE):
                own = ids.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own, *transformed(own.to_pylist(), texts.slice(i, j - i), seed, percent, suffix_first)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text that an output was made of."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP13_SQL = f"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
numbers AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
