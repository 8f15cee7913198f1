"""Token ids of whole texts, and their compact file format.

Tokenising: a pre-tokeniser cuts a text before any merge, so a text may be cut at a subset of those
cuts and each distinct piece encoded once.  Arrow cuts a batch of texts before blanks and signs,
numbers the runs and looks them up in the worker's memory; the pieces of new runs are encoded many at
a time, and Arrow strings the runs' ids together.  Texts with the four separators that libraries class
differently stay whole, and those with blanks after other space are cut in Python.

File format: ids are replaced by their frequency rank.  Four ranks share a control byte of four
2-bit lengths; control bytes and data bytes (1 to 4 per rank, little end first) are kept apart.  A
block of documents is one row of a Parquet table.  Decoding looks each control byte's four lengths
up in a table, and gathers the data bytes at their running sums.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import scratch_folder, sliced, staged, table

#: Bytes of runs and ids that a worker remembers, at most; of more, the half that was met last stays.
REMEMBERED = 1 << 25
#: Ids of one block of the file format, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Four lengths (1 to 4) of every control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)
_ODD = re.compile("[\x02\x1c-\x1f]")
_LATIN = re.compile("[\x00-\x1b\x20-\u024f\u2013-\u2026\u20ac]*")
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Texts in which blanks are no cuts: odd separators, or (byte level only) a blank after other space.
_WHOLE = {True: "[\x02\x1c-\x1f]", False: "[\x02\x1c-\x1f]|[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "}
#: Marks the cuts, which are before blanks and between a letter and a sign or line feed.
_CUT = "\x02"
_SIGNS = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([!-/:-@\\[-`{-~\n])"
#: Cuts of Latin text, all of them also made by the byte-level and the word-end pre-tokeniser.
_FINE = {
    False: re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W_]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    True: re.compile(r"'(?:[stmdSTMD]|[rR][eE]|[vV][eE]|[lL][lL])|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}
#: Pieces that either pre-tokeniser leaves whole, so that it may be left out.
_LETTERS = re.compile("( ?)[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: New pieces that are encoded as one text.
TOGETHER = 256


class Encoder:
    """A tokenizer file with a memory of runs of characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # their strings in a text are ordinary text
        suffix = json.loads(self.t.to_str())["model"].get("end_of_word_suffix")
        self.words = bool(suffix)
        vocabulary = self.t.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("over 65,536 ids")
        self.ends = np.zeros(1 << 16, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        else:
            self.ends[self.t.encode("\n", add_special_tokens=False).ids] = True
        self.plain = Tokenizer.from_str(self.t.to_str())
        self.plain.encode_special_tokens = True
        cut = pre_tokenizers.WhitespaceSplit() if self.words else pre_tokenizers.Split("\n", "isolated")
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.runs, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def cut(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text]
        if _LATIN.fullmatch(text):
            return _FINE[self.words].findall(text)
        return text.split() if self.words else _SPACED.findall(text)

    def pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece.  Letters go together, apart by word ends or by line feeds."""
        out: dict[str, bytes] = {}
        # in a text of words the blanks are cut away, at byte level a piece keeps its own
        letters = [p for p in pieces if (m := _LETTERS.fullmatch(p)) and not (self.words and m[1])]
        groups = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        joined = self.plain.encode_batch_fast([(" " if self.words else "\n").join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, joined):
            ids = np.array(e.ids, dtype="<u2")
            at = np.flatnonzero(self.ends[ids])
            if len(at) != len(group) - (not self.words):
                continue
            stop = np.append(at, len(ids)) if not self.words else at + 1
            start = np.append(0, at + 1)[: len(group)]
            raw = ids.tobytes()
            out.update(zip(group, [raw[2 * x : 2 * y] for x, y in zip(start.tolist(), stop.tolist())]))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, [np.array(e.ids, dtype="<u2").tobytes() for e in self.t.encode_batch_fast(rest, add_special_tokens=False)]))
        return out

    def composed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, strung together from those of its distinct pieces."""
        cuts = [[x] if _LETTERS.fullmatch(x) else self.cut(x) for x in texts]
        known = self.pieces(list({p for c in cuts for p in c}))
        return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cuts]

    def spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut before every blank, and how many each text has."""
        texts = pc.replace_substring(texts, " ", _CUT if self.words else _CUT + " ")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _SIGNS, f"\\1{_CUT}\\2"), _CUT)
        numbered = lists.flatten().dictionary_encode()
        values = numbered.dictionary
        n = len(self.runs)
        while n and self.runs.nbytes + self.ids.nbytes > REMEMBERED:
            half = pa.array(np.arange(n - n // 2, n))
            self.runs, self.ids, n = self.runs.take(half), self.ids.take(half), n // 2
        at = pc.index_in(values, value_set=self.runs)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, 0).to_numpy().copy()
        if len(missing):
            added = values.take(pa.array(missing))
            blobs = pa.array(self.composed(added.to_pylist()), pa.binary())
            at[missing] = len(self.runs) + np.arange(len(missing))
            self.runs, self.ids = pa.concat_arrays([self.runs, added]), pa.concat_arrays([self.ids, blobs])
        strung = self.ids.take(pa.array(at)).take(numbered.indices)
        stop = np.frombuffer(strung.buffers()[1], dtype="<i4", count=len(strung) + 1) // 2
        ids = np.frombuffer(strung.buffers()[2] or b"", dtype="<u2", count=int(stop[-1]))
        return ids, np.diff(stop[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64))]).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, _WHOLE[self.words]).to_numpy(zero_copy_only=False)
        ids, n = self.spaced(texts.filter(pa.array(~whole)) if whole.any() else texts)
        if not whole.any():
            return ids, n
        blobs = self.composed(texts.filter(pa.array(whole)).to_pylist())
        size = np.zeros(len(whole), dtype=np.int64)
        size[~whole], size[whole] = n, [len(b) // 2 for b in blobs]
        out, own = np.empty(size.sum(), dtype="<u2"), np.repeat(whole, size)
        out[~own], out[own] = ids, np.frombuffer(b"".join(blobs), dtype="<u2")
        return out, size


@lru_cache(4)
def _loaded(path: str) -> Encoder:
    return Encoder(path)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as 16-bit little-endian bytes."""
    ids, n = _loaded(path).encode(pa.array(texts, pa.string()))
    return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


def offsets(rows: DataFrame, count: str) -> dict[int, int]:
    """part -> the sum of ``count`` over the parts before it.  One number per partition is collected."""
    sums = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum(count)).collect())
    return dict(zip([p for p, _ in sums], accumulate([n for _, n in sums], initial=0)))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_WRITTEN = re.compile(r"part-(\d{1,6})-[^/]*?(?:[.-]c(\d{1,3}))?(?:\.\w+)*\.parquet")


def file_order(docs: DataFrame) -> bool:
    """Whether ``docs`` is a plain scan of Parquet files that Spark wrote in one go, in the order of their numbers."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return False
    found = [_WRITTEN.fullmatch(os.path.basename(f)) for f in docs.inputFiles()]
    return all(found) and len({(m[1], m[2] or "0") for m in found}) == len(found) > 0


def _file_row() -> F.Column:
    """The row's number over all files: 20 bits of part, 10 bits of file within it, 33 bits of row."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)-", 1)
    number = F.shiftleft(part.cast("long"), 10) + F.coalesce(F.expr("try_cast(nullif(regexp_extract(_metadata.file_name, '[.-]c([0-9]{1,3})[.]', 1), '') as bigint)"), F.lit(0))
    return F.shiftleft(number, 33) + F.col("_metadata.row_index")


def token_bytes(docs: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", counted: bool = False, in_order: bool = False) -> DataFrame:
    """(id, part, start, n, ids): each text's ids with the end id, and its place in its partition.

    With ``in_order``, of a table that Spark wrote, ``part`` is instead a run of rows of one file, numbered by file and
    first row: Spark reads files largest first, and only these numbers follow the order of writing.

    With ``counted`` a last row of each partition has only ``counts``: how often each id came, 64-bit.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("part", "start", "n")], T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, done, after, end = TaskContext.get().partitionId(), 0, None, np.array([end_id], dtype="<u2").tobytes()
        total, kind = np.zeros(1 << 16, dtype=np.int64), None
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        encoder = _loaded(tokenizer)
        for some in sliced(batches, 1, 1 << 21):
            kind = some.column(0).type
            ids, n = encoder.encode(some.column(1))
            if counted:
                total += np.bincount(ids, minlength=1 << 16)
                total[end_id] += len(n)
            raw, stop = ids.tobytes(), np.cumsum(n)
            blobs = [raw[2 * a : 2 * b] + end for a, b in zip((stop - n).tolist(), stop.tolist())]
            n = n + 1
            parts, start = np.full(len(n), part), done + np.cumsum(n) - n
            if written:
                at = some.column(2).to_numpy()
                new = at != np.append(at[0] if after is None else after, at[:-1] + 1)
                new[0] |= after is None
                first = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
                parts = np.where(first < 0, part, at[first])
                start = np.where(first < 0, start, start - start[first])
                part, done, after = int(parts[-1]), int(start[-1] + n[-1]), int(at[-1]) + 1
            else:
                done += int(n.sum())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(parts), pa.array(start), pa.array(n), pa.array(blobs, pa.binary()), pa.nulls(len(n), pa.binary())], schema.names)
        if counted and done:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], schema.names)

    written = in_order and file_order(docs)
    place = [_file_row().alias("at")] if written else []
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *place).mapInArrow(run, schema)
    return out if counted else out.drop("counts")


# ---------------------------------------------------------------- the format
def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    wide = 2 if not len(r) or int(r.max()) <= 0xFFFF else 4
    size = (r > 0xFF).astype(np.uint8)
    if wide == 4:
        size += (r > 0xFFFF).astype(np.uint8) + (r > 0xFFFFFF).astype(np.uint8)
    codes = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    codes[: len(r)] = size
    c = codes.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    data = r.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)[np.arange(wide, dtype=np.uint8) <= size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def id_counts(kept: DataFrame) -> DataFrame:
    """(token, n) over all documents, from the counts that each partition has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n += np.frombuffer(b, dtype=np.int64)
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids])], ["token", "n"])

    return kept.select("counts").where("counts is not null").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_blocks(docs: DataFrame, tokenizer: str, *, end_id: int, path: str | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Write all documents in ascending id order in the block format; what ``open_blocks`` gives for its folder.

    ``path`` (a scratch folder if none is named) gets the blocks and, beside them, the table of ranks.
    The ranks (at most 65,536, the ids a tokenizer file may use here) are the one thing collected.
    Null ids come first; rows that repeat an id stay side by side.
    """
    both = staged(token_bytes(docs, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, counted=True).select("id", "n", "ids", "counts"), "ids", compression="zstd")
    kept = both.where("ids is not null").select("id", "n", "ids")
    by_rank = np.array([r[0] for r in id_counts(both).orderBy(F.col("n").desc(), "token").collect()], dtype=np.int64)
    rank = np.zeros(1 << 16, dtype="<u4")
    rank[by_rank] = np.arange(len(by_rank))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ids_before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, done, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, lengths, blobs = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, done, held
            control, data = pack_ranks(rank[np.frombuffer(b"".join(blobs), dtype="<u2")])
            n, held = held, 0
            row = {"part": [part], "block": [block], "ids_before": [done], "n_ids": [n], "doc_ids": [list(ids)], "lengths": [list(lengths)], "control": [control], "data": [data]}
            block, done = block + 1, done + n
            for x in (ids, lengths, blobs):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                kind = batch.schema.field(0).type
                arrow = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
            for i, n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids.append(i)
                lengths.append(n)
                blobs.append(b)
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
        if ids:
            yield flush()

    p = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = kept.repartitionByRange(p, "id").sortWithinPartitions(F.col("id").asc_nulls_first()).mapInArrow(run, schema)
    path = path or scratch_folder(docs.sparkSession, "blocks")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    docs.sparkSession.createDataFrame(list(enumerate(by_rank.tolist())), "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    return open_blocks(docs.sparkSession, path)


def open_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks of a folder that ``write_blocks`` wrote, and the ids by rank."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    return spark.read.parquet(f"{path}/blocks"), np.array([r["token"] for r in ranks], dtype=np.int64)


def read_blocks(written: DataFrame, by_rank: np.ndarray, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32 (and the ids, 32-bit little-endian)."""
    before, token = offsets(written, "n_ids"), by_rank.astype("<u4")
    fields = [T.StructField(id_col, written.schema["doc_ids"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, ids_before, n, docs, lengths, control, data = (batch.column(i)[row] for i in range(7))
                at = before[part.as_py()] + ids_before.as_py()
                size = np.array(lengths.as_py(), dtype=np.int64)
                raw = memoryview(token[unpack_ranks(control.as_py(), data.as_py(), n.as_py())].tobytes())
                stop = np.cumsum(size)
                parts = [raw[4 * a : 4 * b] for a, b in zip((stop - size).tolist(), stop.tolist())]
                cols = [docs.values, pa.array(at + stop - size), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(x) for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return written.select("part", "ids_before", "n_ids", "doc_ids", "lengths", "control", "data").mapInArrow(run, T.StructType(fields))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    written, by_rank = write_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_blocks(written, by_rank)


QUERIES = {"op2_token_output": op2_token_output}
ORACLE_SQL: dict[str, str] = {}
