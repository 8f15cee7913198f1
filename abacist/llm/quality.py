"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Ratios of length, symbols, stop words and lines come from built-in expressions over the words and
lines of a text.  Repeated 8-word windows are found on 64-bit hashes of the windows; only texts
that have one go through the exact count of the words that such windows cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.common import table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are from or an a he not his but "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de des du et en un une que qui dans pour par sur au avec ce il est pas plus ne se sont "
    "el los las del que y se no una por con para su al lo como pero sus le ha me si sin sobre este o"
).split()
WINDOW = 8
#: (ratio, least, most); a null bound is open, a ratio without a denominator counts as 0.
RULES = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.30),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("shout_ratio", None, 0.30),
    ("upper_ratio", None, 0.50),
    ("letter_ratio", 0.60, None),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.50),
    ("ellipsis_line_ratio", None, 0.30),
    ("bullet_line_ratio", None, 0.90),
)
#: The first rules make up base_failed.
BASE = 2


def let(value, use) -> F.Column:
    """``use(value)`` with ``value`` evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes) -> F.Column:
    """Words under the windows whose hash comes again: each window reaches on to the next one, 8 words at most."""

    def again(s):
        same = lambda k, w: F.coalesce(F.get(s, k)["h"] == w["h"], F.lit(False))
        return F.array_sort(F.filter(F.transform(s, lambda w, k: F.when(same(k - 1, w) | same(k + 1, w), w["i"])), lambda i: i.isNotNull()))

    def total(p):
        reach = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(placed, again), total)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words and the ratios of RULES."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__w", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    d = d.withColumn("__l", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    n = F.size("__w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    covered = let(F.transform(starts, lambda i: F.xxhash64(F.slice("__w", i, WINDOW))), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)))
    stops = F.size(F.filter("__w", lambda w: F.lower(w).isin(*STOP_WORDS)))
    lines = F.size("__l")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    counted = {
        "__letters": count(r"\p{L}"),
        "__n_words": n.cast("long"),
        "__word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "__n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        "__n_dup_lines": (lines - F.size(F.array_distinct("__l"))).cast("long"),
        "__n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    d = d.withColumns(counted)
    ratios = {
        "__repeat_ratio": share(F.col("__n_repeat_words"), n),
        "__mean_word_chars": share(F.col("__word_chars"), n),
        "__symbol_ratio": share(F.col("__n_symbols"), n),
        "__shout_ratio": share(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), n),
        "__upper_ratio": share(count(r"\p{Lu}"), F.col("__letters")),
        "__letter_ratio": share(F.col("__letters"), F.col("__word_chars")),
        "__stop_word_ratio": share(stops, n),
        "__dup_line_ratio": share(F.col("__n_dup_lines"), lines),
        "__ellipsis_line_ratio": share(F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), lines),
        "__bullet_line_ratio": share(F.size(F.filter("__l", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "·"))), lines),
    }
    return d.withColumns(ratios).drop("__w", "__l", "__letters")


def verdict(rules=RULES) -> F.Column:
    """All thresholds of the table as one condition."""
    held = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            held = held & (F.col(f"__{name}") >= least)
        if most is not None:
            held = held & (F.col(f"__{name}") <= most)
    return held


def quality(docs: DataFrame, *, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the counts, base_failed and kept.

    Null and empty texts have no words and fail.  Repeated rows are judged alike; extra columns of
    any name are ignored; an empty table gives an empty result.
    """
    d = measured(docs.select(id_col, F.col(text_col).alias("__text")), "__text")
    base = ~verdict(rules[:BASE])
    counts = [F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select(id_col, *counts, base.alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, *, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` that meet every rule, all columns as they were."""
    # a generator keeps the condition above the projection, so that its counts are made once
    passed = F.explode(F.when(verdict(rules), F.array(F.lit(1))))
    rows = measured(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text")), "__text")
    return rows.select("__row", passed).select("__row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT rid, sum(least(8, coalesce(nx - i, 8))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS lines, length(t) - length(replace(t, '!', '')) AS shouts,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops,
         len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS ell,
         len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•', '·'))) AS bul
  FROM w LEFT JOIN cov USING (rid)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS rep,
         CASE WHEN lines > 0 THEN n_dup_lines / lines ELSE 0 END AS dl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words
         AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1 AND shouts / n_words <= 0.3
         AND CASE WHEN letters > 0 THEN upper / letters ELSE 0 END <= 0.5
         AND letters / word_chars >= 0.6 AND stops / n_words >= 0.02 AND dl <= 0.5
         AND ell / lines <= 0.3 AND bul / lines <= 0.9 AS kept
FROM r
"""

QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL = {"op5_quality": OP5_SQL}
