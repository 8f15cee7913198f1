"""Benchmark decontamination as a prefix-filtered set join of documents with benchmark windows.

A window is ten consecutive words of an item, seen as the set of its five-word shingles.  It can only
occur where all its shingles do, so a prefix of one shingle suffices, and the rarest is taken: a pass
over all documents counts the windows' shingles, and a window of which one never comes is done with.
A second pass looks up the rarest shingles only.  A place found must leave room for the rest of the
window before and after it inside its document; then the words themselves are compared.

Words and shingles are hashed for a whole batch at once: prefix sums of bytes times powers give every
word's polynomial in two steps.  Two words or shingles with one hash cost a comparison, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import sliced, staged, table

WINDOW = 10
SHINGLE = 5
#: Bytes of window text that go to the tasks at once; a larger benchmark is taken in several parts.
PART_BYTES = 1 << 24
#: Bytes of document text that are hashed at once; a longer text by itself.
SLICE = 1 << 21
#: Bits of the table that turns most shingles down before they are looked up.
SIEVE = 22
_BLANK = 0x20
_ONE = np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_NEXT = np.uint64(0x94D049BB133111EB)


def _table() -> np.ndarray:
    """Bytes of words as they are, A-Z lower-cased; any other byte is a blank."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = word[65:91] = True
    return np.where(word, t, _BLANK).astype(np.uint8)


_PLAIN = _table()
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the polynomial's base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _STEP), ("down", _BACK)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = _ONE
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _TURN
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of a batch of texts, one text after the other."""

    plain: np.ndarray  # bytes, lower-cased, others blank
    start: np.ndarray  # of each word in ``plain``
    stop: np.ndarray
    text_at: np.ndarray  # where each text begins in ``plain``, and the end
    upto: np.ndarray  # words before each text, and all

    @staticmethod
    def of(texts: pa.Array) -> Words:
        joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        at = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = np.frombuffer(joined.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        plain, at = _PLAIN[raw], at - at[0]
        inside = np.zeros(len(plain) + 1, dtype=bool)
        np.not_equal(plain, _BLANK, out=inside[1:])  # the last byte is a line feed
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return Words(plain, edge[::2], edge[1::2], at, np.searchsorted(edge[::2], at))

    def hashes(self) -> np.ndarray:
        up, down = _power(len(self.plain) + 1)
        total = np.zeros(len(self.plain) + 1, dtype=np.uint64)
        np.cumsum(self.plain * up[: len(self.plain)], out=total[1:])
        return _mixed((total[self.stop] - total[self.start]) * down[self.start])

    def shingles(self, h: np.ndarray, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on, over text borders too."""
        n = max(len(h) - size + 1, 0)
        out = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            out = out * _NEXT + h[k : k + n]
        return _mixed(out)

    def line(self) -> tuple[bytes, np.ndarray]:
        """All words with a blank after each, and where each word begins there."""
        kept = self.plain != _BLANK
        kept[self.stop] = True
        return self.plain[kept].tobytes(), np.append(0, np.cumsum(self.stop - self.start + 1))


class Sieve:
    """A sorted set of 64-bit hashes with a table of their low bits before it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.low = np.zeros(1 << SIEVE, dtype=bool)
        self.low[hashes & np.uint64((1 << SIEVE) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of members of the set, and which member each is (the first of equal ones)."""
        at = np.flatnonzero(self.low[h & np.uint64((1 << SIEVE) - 1)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        return at[same], k[same]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def windows_of(items: DataFrame, *, size: int, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """(window, n_words, shingles, items): every distinct window with the ids of its items, null ids left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in sliced(batches, 1, SLICE):
            w = Words.of(some.column(1))
            h, (line, at) = w.hashes(), w.line()
            k = {s: w.shingles(h, s) for s in range(1, shingle + 1)}
            rows: list[tuple] = []
            for i, (a, b) in enumerate(zip(w.upto[:-1].tolist(), w.upto[1:].tolist())):
                n = min(size, b - a)
                s = min(shingle, n)
                rows += [(i, line[at[x] : at[x + n] - 1].decode(), n, k[s][x : x + n - s + 1].view(np.int64).tolist()) for x in range(a, b - n + 1) if n]
            if rows:
                i, text, n, own = zip(*rows)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)), pa.array(text), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["item", "window", "n_words", "shingles"])

    schema = T.StructType([T.StructField("item", items.schema[item_col].dataType), T.StructField("window", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    found = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return found.groupBy("window").agg(F.first("n_words").alias("n_words"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))


def shingle_counts(docs: DataFrame, hashes: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often each of the sorted ``hashes`` comes in all documents; those that never come are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sieve = np.zeros(len(hashes), dtype=np.int64), Sieve(hashes)
        for some in sliced(batches, 0, SLICE):
            w = Words.of(some.column(0))
            h = w.hashes()
            for s in sizes:
                at, k = sieve.find(w.shingles(h, s))
                if len(at):
                    inside = at + s <= w.upto[np.searchsorted(w.upto, at, "right")]
                    n += np.bincount(k[inside], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([_signed(hashes[some]), pa.array(n[some])], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window that may occur, with its rarest shingle and that shingle's place (equally rare: the first)."""
    each = windows.select("window", F.posexplode("shingles").alias("at", "shingle")).join(counts, "shingle", "left")
    best = each.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "shingle")).alias("best"))
    return windows.join(best.where("best.n > 0"), "window").select("window", "n_words", "items", F.col("best.shingle").alias("shingle"), F.col("best.at").cast("long").alias("at"))


class Index:
    """Windows by the hash of their rarest shingle."""

    def __init__(self, rows: pa.Table, shingle: int):
        key = rows["shingle"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.at, self.size = (rows[c].to_numpy()[order] for c in ("at", "n_words"))
        take = pa.array(order)
        self.text = [x.encode() for x in rows["window"].take(take).to_pylist()]
        self.items = rows["items"].take(take).combine_chunks()
        self.shingles = sorted({min(shingle, n) for n in self.size.tolist()})

    def places(self, w: Words, sieve: Sieve) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in the batch."""
        h, found = w.hashes(), []
        for s in self.shingles:
            at, k = sieve.find(w.shingles(h, s))
            last = np.searchsorted(self.key, self.key[k], "right")
            many = last - k
            win = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(k, many)
            first = np.repeat(at, many) - self.at[win]
            text = np.searchsorted(w.upto, np.repeat(at, many), "right") - 1
            fits = (first >= w.upto[text]) & (first + self.size[win] <= w.upto[text + 1])
            found.append((first[fits], win[fits]))
        first, win = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if not len(first):
            return first, win
        line, at = w.line()
        same = np.array([line[a:b] == self.text[k] for a, b, k in zip(at[first].tolist(), (at[first + self.size[win]] - 1).tolist(), win.tolist())])
        return first[same], win[same]


_SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("first_word", "words", "first_byte", "bytes")])
_ARROW_SPAN = pa.struct([(c, pa.int64()) for c in ("first_word", "words", "first_byte", "bytes")])


def _lists(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values)


def occurrences(docs: DataFrame, index: pa.Table, shingle: int, item_type: T.DataType, *, hit_only: bool) -> DataFrame:
    """(id, row, n_words, items, spans) of the documents."""
    fields = [docs.schema["id"], T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", T.ArrayType(_SPAN))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(index, shingle)
        sieve = Sieve(own.key)
        for some in sliced(batches, 2, SLICE):
            w = Words.of(some.column(2))
            first, win = own.places(w, sieve)
            mark = np.zeros(len(w.start) + 1, dtype=np.int64)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + own.size[win], -1)
            hit = np.zeros(len(w.start) + 2, dtype=bool)
            hit[1:-1] = np.cumsum(mark[:-1]) > 0
            border = w.upto[1:-1]
            begin = np.unique(np.append(np.flatnonzero(hit[1:-1] & ~hit[:-2]), border[hit[border + 1] & hit[border]] if len(border) else []).astype(np.int64))
            end = np.unique(np.append(np.flatnonzero(hit[1:-1] & ~hit[2:]) + 1, border[hit[border + 1] & hit[border]] if len(border) else []).astype(np.int64))
            text = np.searchsorted(w.upto, begin, "right") - 1
            span = [begin - w.upto[text], end - begin, w.start[begin] - w.text_at[text], w.stop[end - 1] - w.start[begin]]
            spans = _lists(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in span], fields=list(_ARROW_SPAN)), np.bincount(text, minlength=some.num_rows))
            pairs = np.unique(np.stack([np.searchsorted(w.upto, first, "right") - 1, win], 1), axis=0)
            items = _items(pairs, own.items, some.num_rows)
            out = pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.diff(w.upto), pa.int64()), items, spans], [f.name for f in fields])
            yield out.filter(pc.greater(pc.list_value_length(spans), 0)) if hit_only else out

    return docs.select("id", "row", "text").mapInArrow(run, T.StructType(fields))


def _items(pairs: np.ndarray, by_window: pa.Array, n: int) -> pa.Array:
    """Distinct items of the (text, window) pairs as a list for each of ``n`` texts."""
    kind = by_window.type.value_type
    own: list[dict] = [{} for _ in range(n)]
    for t, k in pairs.tolist():
        own[t] |= dict.fromkeys(by_window[k].as_py())
    return pa.array([list(x) for x in own], pa.list_(kind))


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row a document of results by parts of the benchmark; the first part has all documents."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(4).to_pylist():
                joined: list[dict] = []
                for s in spans:
                    last = joined[-1] if joined else None
                    if last and s["first_word"] <= last["first_word"] + last["words"]:
                        for a, b in (("first_word", "words"), ("first_byte", "bytes")):
                            last[b] = max(last[b], s[a] + s[b] - last[a])
                    else:
                        joined.append(s)
                out.append(joined)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(_ARROW_SPAN))], batch.schema.names)

    found = found.select("id", "row", "n_words", "items", "spans")
    return found.mapInArrow(run, found.schema)


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where benchmark items occur in documents: one row a document.

    ``n_words``; ``n_hit``, the words inside any occurrence of a window of ``window`` consecutive item words (an
    item of fewer words is one window); ``items``, the distinct items with an occurring window; ``spans``, the hit
    stretches by word and by byte of UTF-8.  Null and empty texts have no words.  Repeated documents are rows of
    their own; repeated items count once, and items without an id hit words but are not listed.  Either table may
    be empty.  Only the two columns of each table are read.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    item_type = items.schema[item_col].dataType
    windows = staged(windows_of(items, size=window, shingle=shingle, item_col=item_col, text_col=item_text_col), "windows")
    weight = windows.agg(F.sum(F.octet_length("window") + 8 * F.size("shingles") + 8 * F.size("items"))).first()[0] or 0
    n = max(1, -(-weight // PART_BYTES))
    if n > 1:  # each part reads the documents again, and must find the same rows
        kept = staged(kept, "documents")
    parts = []
    for p in range(n):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == p)
        sizes = [r[0] for r in some.select(F.least("n_words", F.lit(shingle)).cast("int")).distinct().collect()]
        hashes = np.array([r[0] for r in some.select(F.explode("shingles")).distinct().collect()], dtype=np.int64).view(np.uint64)
        index = rarest(some, shingle_counts(kept, np.sort(hashes), sorted(sizes)))
        parts.append(occurrences(kept, index.select("window", "n_words", "items", "shingle", "at").toArrow(), shingle, item_type, hit_only=p > 0))
    out = parts[0] if n == 1 else merged(parts)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["words"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the ten-word windows of the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op13_decontaminate": op13_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op13_decontaminate": f"""
with d as (select row_number() over () r, doc_id, {_WORDS} w from documents),
i as (select item_id, {_WORDS} w from benchmark),
win as (select distinct item_id, least(len(w), 10) k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') x
  from i, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(s) where len(w) > 0),
place as (select r, s, k, array_to_string(w[s:s + k - 1], ' ') x from d, (select distinct k from win) ks, unnest(range(1, len(w) - k + 2)) t(s)),
hit as (select distinct r, s, k, item_id from place join win using (k, x)),
word as (select r, count(distinct p) n_hit from (select distinct r, s, k from hit) h, unnest(range(s, s + k)) t(p) group by r),
item as (select r, count(*) n, string_agg(v, ',' order by v) names from (select distinct r, item_id::varchar v from hit where item_id is not null) group by r)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join word using (r) left join item using (r)"""
}
