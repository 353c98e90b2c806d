"""Secret scan: keyword automaton, anchored patterns near its hits, checksum validation.

One Aho-Corasick automaton runs over the lower-cased text. Only where it hits
is the pattern of the hit's kind tried, anchored there. Hexadecimal runs have
no keyword, so they are taken by one linear pass. Tokens that embed a checksum
are reported only if it holds.

Kinds, in order: assign, access, hex (all matches of the contract), then
checked: ghp_/gho_/ghu_/ghs_/ghr_/npm_ tokens whose last six characters are
the base-62 CRC-32 of the rest, and jwt: three base64url parts whose header is
JSON with an "alg".

Matches of one kind are leftmost and don't overlap; spans of several kinds
may, and both are given, by start and then by kind. Null texts are empty. Rows
keep their ids, null or repeated ones too, and equal rows are told apart by
nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked", "jwt")
#: The keywords of the automaton, and the kind each stands for.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked", "eyj": "jwt"}
ANCHORED = {
    "assign": re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "checked": re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    # a run is tried at its beginning only, so that a long one costs no more than its length
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)"),
}
HEX = re.compile(r"[0-9a-f]{32,}")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Digits of base 62 in the order that the token formats use.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(6, "0")


def jwt_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # no base64, no UTF-8, no JSON, or one that is nested too deeply to be a header
        return False
    return isinstance(header, dict) and "alg" in header


def holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    return checksum(m[2]) == m[3] if kind == "checked" else jwt_header(m[1])


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans_of(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret, by start, then kind as listed."""
    hits: dict[str, list[int]] = {}
    for last, (kind, n) in keywords.iter(text.translate(_LOWER)):
        hits.setdefault(kind, []).append(last - n + 1)
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        done, pattern = 0, ANCHORED[kind]
        for at in sorted(starts):
            if at >= done and (m := pattern.match(text, at)):
                done = m.end()
                if holds(kind, m):
                    out.append((at, done, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start, end, kind>> of docs (doc_id, text); places are code points, ends exclusive."""
    kind = "array<struct<start: int, end: int, kind: string>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        keywords = automaton()
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(x or "", keywords)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, arrow)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {kind}")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    kinds = ", ".join(f"'{k}'" for k in BASE)
    counts = [f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS LONG) AS n_{k}" for k in BASE]
    return secret_spans(table(spark, sf_dir, "documents")).selectExpr("doc_id", *counts, f"sha2({text.format(f'filter(spans, x -> x.kind IN ({kinds}))')}, 256) AS base_sha256", f"{text.format('spans')} AS spans")


_ASSIGN = """(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: As this engine's patterns look neither ahead nor behind, checked tokens are matched with the character behind them, jwt with the one before.
_SQL_KINDS = {
    "assign": _ASSIGN,
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{32,}",
    "checked": "(?:gh[pousr]_|npm_)[A-Za-z0-9]{36}(?:[^A-Za-z0-9]|$)",
    "jwt": "(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+",
}
_all = " UNION ALL ".join(f"SELECT rid, '{kind}' AS kind, {k} AS k, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS seps FROM d" for k, (kind, p) in enumerate(_SQL_KINDS.items()))
_crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(5, 35), lambda i: CAST(ascii(substr(m, i, 1)) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
_digits = " || ".join(f"substr('{DIGITS}', CAST(n // {62**k} % 62 AS INTEGER) + 1, 1)" for k in range(5, -1, -1))
#: The same with the rest of the method: checksums bit by bit, headers decoded.
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, kind, k, unnest(ms) AS m, unnest(seps[:len(ms)]) AS sep, generate_subscripts(ms, 1) AS i FROM ({_all})),
y AS (SELECT *, CAST(sum(length(sep) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) - length(m) AS BIGINT) AS begun FROM x),
c AS (SELECT *, CASE WHEN kind = 'checked' THEN {_crc} END AS n, CASE WHEN kind = 'jwt' THEN translate(regexp_extract(m, 'eyJ[A-Za-z0-9_-]+'), '-_', '+/') END AS header FROM y),
h AS (SELECT *, TRY(decode(from_base64(header || repeat('=', (4 - length(header) % 4) % 4)))) AS body FROM c),
s AS (SELECT rid, kind, k, begun + CASE WHEN kind = 'jwt' AND NOT starts_with(m, 'eyJ') THEN 1 ELSE 0 END AS a, CASE WHEN kind = 'checked' THEN begun + 40 ELSE begun + length(m) END AS z FROM h
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{_ASSIGN}', 1)) >= 8 WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN true
    WHEN 'checked' THEN substr(m, 35, 6) = {_digits} ELSE coalesce(json_valid(body) AND json_type(TRY(body::JSON)) = 'OBJECT' AND list_contains(json_keys(TRY(body::JSON)), 'alg'), false) END),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < 3) AS base FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
