"""Personal data: patterns, then information-theoretic sanitisation, in DataFrame functions only.

Direct identifiers are found by patterns. Places come from the lengths of the
matches and of what lies between them, summed by a window, so a text with very
many matches costs no more than its length.

Then the corpus says which terms give an identifier away. For a term t and an
entity e, n(t, e) is the number of lines that hold t within REACH terms of e,
and n(t) the number of lines of the whole corpus that hold t at all. The share
n(t, e) / n(t) estimates p(e | t); in information content this is
PMI(t, e) / IC(e) reaching its maximum of 1 when t occurs with e only. A term
above SHARE that at least SUPPORT lines of different content support is a
disclosure: it gets a span of kind term wherever it stands within reach of e.
sanitise() replaces identifiers by their kind and disclosing terms by a
general word.

Copies of one line don't add to the support. A null text is empty.
Ids may be null or repeated; rows are told apart by an id of their own. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
#: Fixed values. A match can only begin where its run begins or where the last match ended; that keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?+[0-9]){11}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{4,}"
REACH, SUPPORT, SHARE = 6, 3, 0.5


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.when((n >= 12) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def holds(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == "ip", parts).when(kind == "card", luhn(digits)).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True))


def located(rows: DataFrame, group: list[str], text: str, pattern: Column, *keep: str) -> DataFrame:
    """A row for each match of the pattern: group, keep, k, at (line breaks before it), start, end, match; places in code points. A match has no line break."""
    pairs = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("match"))
    size, bare = F.length("pair.gap"), F.length(F.replace(F.col("pair.gap"), F.lit("\n"), F.lit("")))
    each = rows.select(*group, *keep, F.posexplode(pairs).alias("k", "pair")).select(*group, *keep, "k", size.cast("long").alias("gap"), (size - bare).alias("breaks"), F.col("pair.match").alias("match")).where("match IS NOT NULL")
    by = f"OVER (PARTITION BY {', '.join(group)} ORDER BY k)"
    end = each.selectExpr("*", f"sum(gap + length(match)) {by} AS end", f"CAST(sum(breaks) {by} AS INT) AS at")
    return end.selectExpr(*group, *keep, "k", "at", "end - length(match) AS start", "end", "match")


def prepared(docs: DataFrame) -> DataFrame:
    """rid, doc_id, and for texts that may hold an identifier the kinds to try and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = F.filter(F.array(*[F.when(text.rlike(NEEDS[k]), F.lit(k)) for k in BASE]), lambda k: k.isNotNull())
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"), kinds.alias("kinds")).withColumn("text", F.when(F.size("kinds") > 0, F.col("text")))


def identifiers(held: DataFrame) -> DataFrame:
    """rid, kind, line (from 0), start, end, match of the direct identifiers in prepared rows."""
    rows = held.where("text IS NOT NULL").select("rid", "text", F.explode("kinds").alias("kind"))
    each = [located(rows.where(F.col("kind") == k), ["rid"], "text", F.lit(PATTERNS[k])).withColumn("kind", F.lit(k)) for k in BASE]
    found = each[0]
    for x in each[1:]:
        found = found.unionByName(x)
    return found.where(holds(F.col("kind"), F.col("match"))).select("rid", "kind", F.col("at").alias("line"), "start", "end", "match")


def disclosures(docs: DataFrame, held: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, kind, start, end of terms that give an identifier of their line away."""
    texts = held.join(found.select("rid").distinct(), "rid", "left_semi").select("rid", "text")
    lines = texts.select("rid", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    lines = lines.selectExpr("*", "coalesce(sum(length(body) + 1L) OVER (PARTITION BY rid ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS begin")
    entities = found.select("rid", "line", F.col("start").alias("a"), F.col("end").alias("z"), F.concat_ws(":", "kind", F.lower("match")).alias("entity"))
    chosen = lines.join(entities.select("rid", "line").distinct(), ["rid", "line"], "left_semi").withColumn("hash", F.xxhash64("body"))
    terms = located(chosen, ["rid", "line"], "body", F.lit(TERM), "begin", "hash").selectExpr("rid", "line", "k", "hash", "begin + start AS start", "begin + end AS end", "lower(match) AS term")
    # the entity's place among the terms, then the terms within reach of it
    marks = terms.select("rid", "line", "k", "start", F.lit(None).cast("string").alias("entity"), F.lit(None).cast("long").alias("z"), F.lit(1).alias("n")).unionByName(
        entities.select("rid", "line", F.lit(-1).alias("k"), F.col("a").alias("start"), "entity", "z", F.lit(0).alias("n"))
    )
    placed = marks.selectExpr("rid", "line", "entity", "start AS a", "z", "sum(n) OVER (PARTITION BY rid, line ORDER BY start, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at").where("entity IS NOT NULL")
    around = placed.select("rid", "line", "entity", "a", "z", F.explode(F.sequence(F.col("at") - REACH, F.col("at") + 2 * REACH)).alias("k"))
    near = scratch.keep(around.join(terms, ["rid", "line", "k"]).where("end <= a OR start >= z").select("rid", "line", "hash", "entity", "term", "start", "end"))
    pairs = near.groupBy("term", "entity").agg(F.countDistinct("rid", "line").alias("n"), F.countDistinct("hash").alias("support")).where(F.col("support") >= SUPPORT)
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("body"))
    corpus = words.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("all"))
    told = pairs.join(corpus, "term").where(F.col("n") >= SHARE * F.col("all")).select("term", "entity")
    return near.join(told, ["term", "entity"]).selectExpr("rid", "'term' AS kind", "start", "end").distinct()


def personal_spans(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, spans): prepared rows, and rid, spans array<struct<start, rank, kind, end>> in order for rows with any."""
    scratch = Scratch(spark, "pii")
    docs = docs.select("doc_id", "text")
    held = scratch.keep(prepared(docs))
    found = scratch.keep(identifiers(held))
    everything = found.select("rid", "kind", "start", "end").unionByName(disclosures(docs, held, found, scratch))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return held, everything.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))


def sanitise(held: DataFrame, spans: DataFrame) -> DataFrame:
    """rid, doc_id, text with identifiers replaced by <kind> and disclosing terms by <term>; overlapping spans are cut once, the first one names them."""
    both = held.join(spans, "rid").where("text IS NOT NULL")
    start = "named_struct('at', 0L, 'parts', CAST(array() AS array<string>))"
    step = "(a, s) -> IF(s.start < a.at, a, named_struct('at', s.end, 'parts', concat(a.parts, array(substr(text, CAST(a.at + 1 AS INT), CAST(s.start - a.at AS INT)), concat('<', s.kind, '>')))))"
    return both.selectExpr("rid", "doc_id", f"aggregate(spans, {start}, {step}, a -> concat(array_join(a.parts, ''), substr(text, CAST(a.at + 1 AS INT)))) AS text")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, spans = personal_spans(spark, table(spark, sf_dir, "documents"))
    text = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [f"CAST(size(filter(s, x -> x.kind = '{k}')) AS LONG) AS n_{k}" for k in BASE]
    rows = held.select("rid", "doc_id").join(spans, "rid", "left").selectExpr("doc_id", "coalesce(spans, array()) AS s")
    base = text.format("filter(s, x -> x.kind <> 'term')")
    return rows.selectExpr("doc_id", *counts, f"sha2({base}, 256) AS base_sha256", f"{text.format('s')} AS spans")


_plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
_good = {
    "email": "true", "ip": "list_bool_and(list_transform(string_split(match, '.'), lambda p: CAST(p AS HUGEINT) <= 255))", "phone": "length(regexp_replace(match, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "card": "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(digits, length(digits) - i + 1, 1) AS INTEGER) ELSE 2 * CAST(substr(digits, length(digits) - i + 1, 1) AS INTEGER) - CASE WHEN CAST(substr(digits, length(digits) - i + 1, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
}


def _sql_located(rows: str, key: str, text: str, pattern: str, *keep: str) -> str:
    """Matches with their places, from what lies between them."""
    names = "".join(f", {c}" for c in keep)
    return f"""(SELECT {key}{names}, k, "end" - length(match) AS start, "end", match FROM (SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY {key} ORDER BY k) AS BIGINT) AS "end"
  FROM (SELECT {key}{names}, unnest(range(len(ms))) AS k, unnest(ms) AS match, unnest(gs[1:len(ms)]) AS gap FROM (SELECT {key}{names}, regexp_extract_all({text}, '{pattern}') AS ms, regexp_split_to_array({text}, '{pattern}') AS gs FROM {rows}) WHERE len(ms) > 0)))"""


_found = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {n} AS rank, start, \"end\", match FROM (SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS digits FROM {_sql_located('d', 'rid', 'body', _plain[k])}) WHERE {_good[k]}" for n, k in enumerate(BASE, 1))
_of = lambda k: f"count(*) FILTER (kind = '{k}') AS n_{k}"
_text = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank, \"end\") FILTER ({where}), '')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
f AS ({_found}),
l0 AS (SELECT rid, unnest(string_split(body, chr(10))) AS body, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line FROM d),
l1 AS (SELECT *, CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY rid ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM l0),
e AS (SELECT rid, line, start AS a, "end" AS z, kind || ':' || lower(match) AS entity FROM f JOIN l1 USING (rid) WHERE start >= begin AND start < begin + length(body)),
ch AS (SELECT rid || '/' || line AS id, rid, line, body, begin, md5(body) AS hash FROM l1 SEMI JOIN e USING (rid, line)),
t AS (SELECT rid, line, k, hash, begin + start AS start, begin + "end" AS "end", lower(match) AS term FROM {_sql_located('ch', 'id', 'body', TERM, 'rid', 'line', 'begin', 'hash')}),
p AS (SELECT e.*, (SELECT count(*) FROM t WHERE t.rid = e.rid AND t.line = e.line AND t.start < e.a) AS place FROM e),
near AS (SELECT p.rid, p.line, hash, entity, term, start, "end" FROM p JOIN t ON t.rid = p.rid AND t.line = p.line AND k BETWEEN place - {REACH} AND place + {2 * REACH} WHERE "end" <= a OR start >= z),
pairs AS (SELECT term, entity, count(DISTINCT rid || '/' || line) AS n FROM near GROUP BY ALL HAVING count(DISTINCT hash) >= {SUPPORT}),
corpus AS (SELECT term, count(*) AS every FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(body), '{TERM}'))) AS term FROM l0) GROUP BY term),
s AS (SELECT rid, kind, rank, start, "end" FROM f UNION ALL SELECT DISTINCT rid, 'term', {len(KINDS)}, start, "end" FROM near SEMI JOIN (SELECT term, entity FROM pairs JOIN corpus USING (term) WHERE n >= {SHARE} * every) x USING (term, entity))
SELECT any_value(doc_id) AS doc_id, {', '.join(_of(k) for k in BASE)}, sha256({_text("kind <> 'term'")}) AS base_sha256, {_text("kind IS NOT NULL")} AS spans FROM d LEFT JOIN s USING (rid) GROUP BY rid
"""
