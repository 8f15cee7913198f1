"""Language identification by rank-order profiles.

A language profile is the ranked list of its most frequent letter n-grams (1 to 3 letters, word
edges count as a blank).  A document's own ranked list is compared with each profile: every n-gram
adds the difference of its two ranks, or the full length of the list where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.common import sliced, table

#: N-grams of a profile and of a document that are ranked.
RANKS = 300
#: The learned languages are collected; more than this many are refused, not cut.
MOST_LANGUAGES = 5000
_BI, _UNI = np.uint64(1 << 62), np.uint64(1 << 63)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    return np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint64, count=0x110000)


def grams(text: str | None) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text, with repeats; none if it has no letter."""
    c = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = np.concatenate([[np.uint64(0)], c, [np.uint64(0)]]).astype(np.uint64)
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
    if len(c) < 3:
        return np.empty(0, dtype=np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    s = np.uint64(21)
    return np.concatenate([c[c != 0] | _UNI, (c[:-1] << s | c[1:]) | _BI, ((a << s | b) << s | d)[b != 0]])


def _ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    if len(found) > RANKS:
        least = np.partition(n, len(n) - RANKS)[len(n) - RANKS]
        found, n = found[n >= least], n[n >= least]
    return found[np.argsort(-n, kind="stable")][:RANKS]


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, code, n): one row per language and n-gram of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
            n = np.zeros(len(codes), dtype=np.int64)
            np.add.at(n, where, np.concatenate([k for _, k in held[lang]]))
            return codes, n

        for batch in sliced(batches, 1):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                if len(held[lang]) > 32:
                    held[lang] = [merged(lang)]
        for lang in held:
            codes, n = merged(lang)
            for i in range(0, len(codes), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part].view(np.int64)), pa.array(n[part])], ["lang", "code", "n"])

    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").mapInArrow(run, "lang string, code long, n long")


def profiles(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """language -> its RANKS most frequent n-gram codes in order, learned from all rows of ``docs``."""
    counts = count_grams(docs, lang_col, text_col).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(32)))
    # unsigned order of the codes, as numpy ranks a document's own ties
    order = [F.col("n").desc(), (F.col("code") < 0).asc(), F.col("code").asc()]
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= RANKS)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= RANKS)
    rows = top.select("lang", "code", "r").take(MOST_LANGUAGES * RANKS + 1)
    if len(rows) > MOST_LANGUAGES * RANKS:
        raise ValueError(f"over {MOST_LANGUAGES} languages: label values are no closed set")
    out: dict[str, list[tuple[int, int]]] = {}
    for lang, code, r in rows:
        out.setdefault(lang, []).append((r, code))
    return {lang: np.array([c for _, c in sorted(v)], dtype=np.int64).view(np.uint64) for lang, v in sorted(out.items())}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` without its text, with the language and a score: 1 less the share of the largest distance.

    Null texts, texts without a letter, and any text when nothing was learned: ``und`` with score 0.
    Equal distances: the language that is first by code point.
    """
    langs = list(learned)
    index = [(np.sort(v), np.argsort(v)) for v in learned.values()]

    def predict(text: str | None) -> tuple[str, float]:
        own = _ranked(grams(text))
        if not len(own) or not langs:
            return "und", 0.0
        own_rank, most, best = np.arange(len(own)), len(own) * RANKS, (1 << 60, "und")
        for lang, (codes, ranks) in zip(langs, index):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            away = np.where(codes[at] == own, np.abs(ranks[at] - own_rank), RANKS)
            best = min(best, (int(away.sum()), lang))
        return best[1], 1 - best[0] / most

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        found = []
        for some in sliced([pa.RecordBatch.from_arrays([texts], ["text"])], 0):
            found += [predict(t) for t in some.column(0).to_pylist()]
        return pa.array([{"lang": lang, "score": score} for lang, score in found], kind)

    marked = docs.withColumn("__guess", guess(F.col(text_col)))
    return marked.select(*[c for c in docs.columns if c != text_col], F.col("__guess.lang").alias(pred_col), F.col("__guess.score").alias(score_col))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Every fifth document by the checksum of its id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_known(docs: DataFrame, *, least_score: float = 0.1, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` without documents in no learned language: no letters, or a score below ``least_score``.

    Profiles come from the documents' own labels, but for the held-out fifth.
    """
    learned = profiles(docs.where(~held_out(id_col)), lang_col=lang_col, text_col=text_col)
    # only the text goes to Python; the rows stay with the JVM
    rows = docs.select(F.col(text_col).alias("__text"), F.struct("*").alias("__row"))
    marked = identify(rows, learned, text_col="__text")
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("__row.*")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), learned)


QUERIES = {"op6_langid": op6_langid}
ORACLE_SQL: dict[str, str] = {}
