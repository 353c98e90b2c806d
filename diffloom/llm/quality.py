"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word
windows. A text that passes them is held against its language: the histogram
of character classes and that of common words are compared with the language's
own, counted over all documents, by the Jensen-Shannon distance (the square
root of the divergence to base 2). A guard keeps short texts, whose histograms
are noise: below MIN_WORDS words there is no verdict, and the limit is raised
by the expected sampling noise of a text of this length.

A null text has no words and fails the base rules. A null language is a
language of its own. Repeated ids are separate rows; extra columns can be
carried; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import let
from .shared import Scratch, table

SEPARATORS = r"[\x20\x09-\x0D]+"
#: Words below which the histograms give no verdict.
MIN_WORDS = 50
#: Class distances that reject alone, and together with a word distance over its limit.
CLASS_LIMIT, CLASS_DOUBT = 0.3, 0.125
#: The word distance's limit for endless texts, and the bins that its sampling noise sqrt(BINS / (8 ln 2 n)) stands for.
WORD_LIMIT, BINS = 0.08, 27
#: Common words of four languages.
COMMON = {
    "en": "the of and to in is that it was for on are as with be at by this from or an which have not you",
    "fr": "le la les de des du et en un une que qui est dans par pour sur pas au aux avec il elle ce ou",
    "de": "der die das und in zu den von mit ist des im dem nicht ein eine als auch es an auf für sich wird bei",
    "es": "el la los las de del y en un una que es por con para se no al lo como más su sus o a",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
#: One character stands for each word.
CODES = [chr(0x4E00 + k) for k in range(len(WORDS))]
#: Character classes, each counted in what the ones before it have left.
CLASSES = [r"\p{Ll}+", r"\p{Lu}+", r"\p{L}+", r"\p{Nd}+", r"[.,;:!?'\"()-]+"]


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        sort = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.transform(s, lambda e, k: F.when(((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["x"] == e["x"])) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["x"] == e["x"])), e["i"]))
        places = F.array_sort(let(sort, lambda s: F.filter(twice(s), lambda p: p.isNotNull())))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return F.when(F.size(words) >= 3, of(words)).otherwise(F.lit(0)).cast("long")


def class_counts(text: Column) -> Column:
    """Characters of each class, last those of no class; text has no separators."""
    build = F.struct(F.length(text).alias("n"), text.alias("rest"), F.array().cast("array<int>").alias("counts"))
    steps = F.aggregate(F.array(*[F.lit(p) for p in CLASSES]), build, lambda a, p: let(F.regexp_replace(a["rest"], p, F.lit("")), lambda r: F.struct(F.length(r).alias("n"), r.alias("rest"), F.concat(a["counts"], F.array(a["n"] - F.length(r))).alias("counts"))))
    return let(steps, lambda s: F.concat(s["counts"], F.array(s["n"])))


def common_counts(text: Column) -> Column:
    """How often each common word occurs, and last all other words."""
    known, codes = F.array(*[F.lit(w) for w in WORDS]), F.array(*[F.lit(c) for c in CODES])
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        found = F.filter(w, lambda x: x.isin(WORDS))
        code = F.array_join(F.transform(found, lambda x: F.substring(F.lit("".join(CODES)), F.array_position(known, x).cast("int"), F.lit(1))), "")
        return let(code, lambda c: F.concat(F.transform(codes, lambda k: F.length(c) - F.length(F.replace(c, k, F.lit("")))), F.array(F.size(w) - F.length(c))))

    return let(words, of)


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, language, the base counts, and the histograms classes and common."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spoken = F.filter(F.split("body", SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.regexp_replace("packed", r"[^#*$%&|<>]+", F.lit(""))
    return (
        docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("language"), *carry, text.alias("body"))
        .select("*", F.regexp_replace("body", SEPARATORS, F.lit("")).alias("packed"))
        .select(
            "doc_id", "language", *carry,
            let(spoken, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
            F.length("packed").cast("long").alias("word_chars"),
            F.length(symbols).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            class_counts(F.col("packed")).alias("classes"),
            common_counts(F.col("body")).alias("common"),
        )
        .select("doc_id", "language", *carry, "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "classes", "common")
    )


def reference(rows: DataFrame) -> DataFrame:
    """The mean histograms of each language, over all documents; those that fail the base rules count for nothing."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def share(c: str) -> Column:
        return let(total(F.col(c)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))).alias(c)

    shares = rows.select("language", "base_failed", share("classes"), share("common"))
    means = lambda c, n: F.array(*[F.coalesce(F.avg(F.when(~F.col("base_failed"), F.col(c)[k])), F.lit(0.0)) for k in range(n)])
    return shares.groupBy("language").agg(means("classes", len(CLASSES) + 1).alias("all_classes"), means("common", len(WORDS) + 1).alias("all_common"))


def distance(counts: Column, others: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 if one of them is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def of(n: Column, m: Column) -> Column:
        both = F.zip_with(counts, others, lambda x, y: let(F.struct((x / n).alias("p"), (y / m).alias("q")), lambda s: part(s["p"], s["q"]) + part(s["q"], s["p"])))
        return F.sqrt(F.greatest(F.lit(0.0), total(both) / 2))

    return let(total(counts), lambda n: let(total(others), lambda m: F.when((n > 0) & (m > 0), of(n, m)).otherwise(F.lit(0.0))))


def judged(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """features with class_distance, word_distance, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = Scratch(spark, "quality").keep(features(docs, carry).withColumn("base_failed", failed))
    told = rows.join(reference(rows), "language").withColumn("class_distance", F.round(distance(F.col("classes"), F.col("all_classes")), 6)).withColumn("word_distance", F.round(distance(F.col("common"), F.col("all_common")), 6))
    strange = F.col("word_distance") > WORD_LIMIT + F.sqrt(BINS / (8 * F.log(F.lit(2.0)) * F.greatest(F.col("n_words"), F.lit(1))))
    odd = (F.col("class_distance") > CLASS_LIMIT) | (strange & (F.col("class_distance") > CLASS_DOUBT))
    return told.withColumn("kept", ~F.col("base_failed") & ~odd).drop("classes", "common", "all_classes", "all_common", "language")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def _sql_distance(mine: str, of_language: str, out: str) -> str:
    """Jensen-Shannon distance of each document's histogram (rid, bin, n) and its language's (language, bin, m)."""
    part = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
    return f"""(SELECT rid, CASE WHEN max(n_all) > 0 AND max(m_all) > 0 THEN round(sqrt(greatest(0, sum({part('x', 'y')} + {part('y', 'x')}) / 2)), 6) ELSE 0 END AS {out}
  FROM (SELECT a.rid, n_all, m_all, CASE WHEN n_all > 0 THEN n / n_all::DOUBLE ELSE 0 END AS x, CASE WHEN m_all > 0 THEN m / m_all ELSE 0 END AS y
    FROM (SELECT *, sum(n) OVER (PARTITION BY rid) AS n_all FROM {mine}) a JOIN (SELECT *, sum(m) OVER (PARTITION BY language) AS m_all FROM {of_language}) b USING (language, bin)) GROUP BY rid)"""


_words_sql = ", ".join("'" + w + "'" for w in WORDS)
_class_sql = "".join(f", regexp_replace(r{k}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g') AS r{k + 1}" for k, p in enumerate(CLASSES))
_mean_sql = lambda rows: f"(SELECT h.language, bin, avg(CASE WHEN n_all > 0 THEN n / n_all::DOUBLE ELSE 0 END) AS m FROM (SELECT *, sum(n) OVER (PARTITION BY rid) AS n_all FROM {rows}) h JOIN base USING (rid) WHERE NOT base_failed GROUP BY ALL)"
#: The same with a row for each bin of each histogram.
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words, regexp_replace(body, '{SEPARATORS}', '', 'g') AS r0, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS solid FROM d),
g AS (SELECT rid, k, words[k + 1] AS a, words[k + 2] AS b, words[k + 3] AS c FROM (SELECT rid, words, unnest(range(0, len(words) - 2)) AS k FROM w WHERE len(words) > 2)),
twice AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT k + i) AS n_repeat_words FROM twice, range(3) t(i) GROUP BY rid),
base0 AS (SELECT w.rid, doc_id, language, len(words) AS n_words, length(r0) AS word_chars, length(regexp_replace(r0, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(solid) - len(list_distinct(solid)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
base AS (SELECT * EXCLUDE (language), n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base0),
cl0 AS (SELECT rid, language, r0{_class_sql} FROM w),
cl AS (SELECT rid, language, unnest(range({len(CLASSES) + 1})) AS bin, unnest([{', '.join(f'length(r{k}) - length(r{k + 1})' for k in range(len(CLASSES)))}, length(r{len(CLASSES)})]) AS n FROM cl0),
sp AS (SELECT rid, unnest(list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM w),
spn AS (SELECT rid, CASE WHEN word IN ({_words_sql}) THEN word ELSE '' END AS bin, count(*) AS n FROM sp GROUP BY ALL),
co AS (SELECT rid, language, v.bin, coalesce(n, 0) AS n FROM w CROSS JOIN (SELECT unnest(['', {_words_sql}]) AS bin) v LEFT JOIN spn USING (rid, bin)),
mcl AS {_mean_sql('cl')}, mco AS {_mean_sql('co')},
dcl AS {_sql_distance('cl', 'mcl', 'class_distance')}, dco AS {_sql_distance('co', 'mco', 'word_distance')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (cd > {CLASS_LIMIT} OR (wd > {WORD_LIMIT} + sqrt({BINS} / (8 * ln(2) * greatest(n_words, 1))) AND cd > {CLASS_DOUBT})) AS kept, cd AS class_distance, wd AS word_distance
FROM (SELECT *, CAST(coalesce(class_distance, 0) AS DOUBLE) AS cd, CAST(coalesce(word_distance, 0) AS DOUBLE) AS wd FROM base LEFT JOIN dcl USING (rid) LEFT JOIN dco USING (rid))
"""
