"""Alignment of two tokenizers over the same bytes.

Both tokenisations of a text cover the same bytes, so each is a rising sequence of cumulative token
ends, and merging the two sequences gives everything: between two neighbouring ends lies one stretch of
one A and one B token, a link; an end that both have closes a group.

A first pass over the documents (mapInPandas) keeps the ids of both sides, and for each block of
documents how many of them hold each linked id pair, so that a frequent pair is one row of a block, not
one of every document.  Spark adds these up, takes each side's maximum, and joins both back to the rows
of the blocks.  A second pass meets each block's documents with its counted pairs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm import tokens
from abacist.llm.common import sliced, staged, table

#: Tokens of a block of documents, about; a longer document is a block of its own.
BLOCK = 1 << 20
#: Bytes of text that are tokenised and merged at once; a longer text by itself.
SLICE = 1 << 20
#: Ids of either side are below this.
IDS = 1 << 16


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible ones stand for themselves, the others come in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bytes:
    """Byte strings of a vocabulary by id."""

    def __init__(self, entries: dict[int, bytes]):
        if max(entries, default=0) >= IDS:
            raise ValueError("over 65,536 ids")
        self.of = pa.array([entries.get(i, b"") for i in range(IDS)], pa.large_binary())
        self.size = np.array([len(entries.get(i, b"")) for i in range(IDS)], dtype=np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        taken = self.of.take(pa.array(ids))
        return bytes(taken.buffers()[2] or b"")[: int(self.size[ids].sum())]


class ByteSide:
    """A byte-level tokenizer file."""

    def __init__(self, path: str):
        self.encoder, byte = tokens.Encoder(path), byte_level()
        self.bytes = Bytes({i: bytes(byte[c] for c in token) for token, i in self.encoder.t.get_vocab(with_added_tokens=False).items()})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))


class PieceSide:
    """A sentence-piece model that puts a blank before each text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        m = self.model
        piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = Bytes({i: piece(i) for i in range(m.get_piece_size())})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts.to_pylist(), num_threads=1) if len(texts) else []
        n = np.array([len(x) for x in lists], dtype=np.int64)
        return np.fromiter(chain.from_iterable(lists), dtype=np.uint16, count=int(n.sum())), n


@lru_cache(2)
def sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a), PieceSide(b)


@lru_cache(2)
def sizes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id on both sides, without keeping the tokenizers."""
    return ByteSide(a).bytes.size, PieceSide(b).bytes.size


def _agrees(side: Bytes, ids: np.ndarray, n: np.ndarray, raw: bytes, at: np.ndarray) -> np.ndarray:
    """Which texts are the bytes of their tokens; text i is ``raw[at[i]:at[i + 1]]``."""
    own, upto = side.joined(ids), np.append(0, np.cumsum(side.size[ids]))[np.append(0, np.cumsum(n))]
    if own == raw and (upto == at).all():
        return np.ones(len(n), dtype=bool)
    return np.array([own[a:b] == raw[x:y] for a, b, x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), at[:-1].tolist(), at[1:].tolist())], dtype=bool)


class Merge:
    """Groups and links of token ends of two sides, one text after the other; all texts end on both sides."""

    def __init__(self, end_a: np.ndarray, end_b: np.ndarray):
        both = np.concatenate([end_a, end_b])
        order = np.argsort(both, kind="stable")  # of two rising runs: a merge
        ends = both[order]
        last = np.flatnonzero(np.append(ends[1:] != ends[:-1], True)) if len(ends) else order
        from_a = np.cumsum(order < len(end_a))[last]
        from_b = last + 1 - from_a
        self.end = ends[last]  # of each link
        self.a, self.b = (np.append(0, x[:-1])[: len(x)] for x in (from_a, from_b))  # tokens of each link
        shared = np.flatnonzero(np.diff(np.append(-1, last)) == 2)
        self.group_end = self.end[shared]
        self.group_a, self.group_b = from_a[shared], from_b[shared]  # tokens up to each group's end


#: Decimal ids followed by what stands between tokens, between sides and between groups.
_WRITTEN = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(IDS)], pa.large_binary())


def written(m: Merge, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text; ``stop``: tokens of both sides up to each text's end."""
    from_a, from_b = np.append(0, m.group_a[:-1])[: len(m.group_a)], np.append(0, m.group_b[:-1])[: len(m.group_b)]
    n_a, n_b = m.group_a - from_a, m.group_b - from_b
    word = np.empty(len(a) + len(b), dtype=np.int64)
    word[np.arange(len(a)) + np.repeat(from_b, n_a)] = a
    word[np.arange(len(b)) + np.repeat(m.group_a, n_b)] = b
    word[m.group_a - 1 + from_b] += IDS
    word[m.group_b - 1 + m.group_a] += 2 * IDS
    text = _WRITTEN.take(pa.array(word))
    at = np.frombuffer(text.buffers()[1], dtype=np.int64)[: len(word) + 1][np.append(0, stop)].tolist()
    raw = bytes(text.buffers()[2] or b"")
    return [raw[x : max(y - 1, x)].decode() for x, y in zip(at[:-1], at[1:])]


def _ends(size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.cumsum(size[ids])


def _squeezed(ids: np.ndarray) -> bytes:
    """16-bit ids, low bytes before high bytes, compressed."""
    return zstandard.compress(ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 3)


def _spread(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(2, -1).T).view("<u2").ravel()


def tokenised(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(block, ids, n_a, n_b, ids_a, ids_b) of some documents, and (block, pairs, docs) of each block: 32-bit id pairs, documents that hold them."""
    schema = "block long, ids array<string>, n_a array<long>, n_b array<long>, ids_a binary, ids_b binary, pairs binary, docs binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        one, two = sides(a, b)
        block, held, counted = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pd.DataFrame:
            pairs, at = np.unique(np.concatenate([p for p, _ in counted]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in counted]), minlength=len(pairs)).astype("<i4")
            counted.clear()
            return pd.DataFrame({"block": [block], **dict.fromkeys(("ids", "n_a", "n_b", "ids_a", "ids_b"), [None]), "pairs": [pairs.astype("<u4").tobytes()], "docs": [n.tobytes()]})

        for frame in frames:
            ids, n = frame["id"], len(frame)
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(frame["text"], pa.string(), from_pandas=True)], ["at", "text"])
            del frame  # its strings
            for some in sliced(iter([batch]), 1, SLICE):
                texts = pc.fill_null(some.column(1), "")
                spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
                size = pc.binary_length(spaced).to_numpy().astype(np.int64)
                at = np.append(0, np.cumsum(size))
                first = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[spaced.offset]
                raw = bytes(spaced.buffers()[2])[first : first + at[-1]]
                (ids_a, n_a), (ids_b, n_b) = one.encode(texts), two.encode(texts)
                good = (size > 1) & _agrees(one.bytes, ids_a, n_a, raw, at) & _agrees(two.bytes, ids_b, n_b, raw, at)
                ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
                n_a, n_b = n_a * good, n_b * good
                m = Merge(_ends(one.bytes.size, ids_a), _ends(two.bytes.size, ids_b))
                doc = np.searchsorted(np.cumsum(size * good), m.end)
                held_by = np.unique(doc << 32 | ids_a[m.a].astype(np.int64) << 16 | ids_b[m.b])
                counted.append(np.unique((held_by & 0xFFFFFFFF).astype(np.uint32), return_counts=True))
                rows = ids.iloc[some.column(0).to_numpy()]
                yield pd.DataFrame({"block": [block], "ids": [rows.tolist()], "n_a": [n_a], "n_b": [n_b], "ids_a": [_squeezed(ids_a)], "ids_b": [_squeezed(ids_b)], "pairs": [None], "docs": [None]})
                held += len(ids_a)
                if held >= BLOCK:
                    yield flush()
                    block, held = block + 1, 0
        if counted:
            yield flush()

    return docs.select(F.col("id").cast("string"), "text").mapInPandas(run, schema)  # pandas would turn integers beside nulls into doubles


def pair_rows(kept: DataFrame) -> DataFrame:
    """(block, pair, n) of the blocks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p, n = np.frombuffer(pairs, dtype="<u4").astype(np.int64), np.frombuffer(n, dtype="<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.array(p), pa.array(n)], ["block", "pair", "n"])

    return kept.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(run, "block long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, a, b, docs, best_a, best_b): documents that hold each pair, and whether that is the most of its A, of its B id."""
    n = pairs.groupBy("pair").agg(F.sum("n").alias("docs")).select("pair", F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(IDS - 1).alias("b"), "docs")
    n = staged(n, "pair_counts")
    for side in ("a", "b"):
        most = n.groupBy(side).agg(F.max("docs").alias(f"most_{side}"))  # at most 65,536 rows
        n = n.join(most, side).withColumn(f"best_{side}", F.col("docs") == F.col(f"most_{side}"))
    return n.select("pair", "a", "b", "docs", "best_a", "best_b")


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("docs", pa.int64()), ("best_a", pa.bool_()), ("best_b", pa.bool_())])
_LINK_SQL = "array<struct<a: int, b: int, first_byte: bigint, end_byte: bigint, docs: bigint, best_a: boolean, best_b: boolean>>"


def align(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the tokens of a byte-level tokenizer file ``a`` and a sentence-piece model ``b``.

    documents: ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``n_best``, the links whose pair is held by as many documents as
    any pair of their A id; ``count_sum``, the documents of all links' pairs added up; ``groups``, their ids; with ``with_links``
    also each link's ids and bytes of blank+text.  pairs: see ``pair_counts``.

    A null or empty text, or one whose joined tokens are not blank+text, has no tokens: zeros and an empty string.  Repeated
    rows and ids are documents of their own.  Of an empty table nothing comes out.  Only the two columns are read.
    """
    kept = staged(tokenised(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), a, b), "ids", compression="none")
    by_block = pair_rows(kept)
    counts = staged(pair_counts(by_block), "pairs")
    counted = by_block.join(counts, "pair").select("block", "pair", "docs", "best_a", "best_b")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"] + ["links"] * with_links
    schema = T.StructType([T.StructField(id_col, T.StringType()), *[T.StructField(c, T.LongType()) for c in names[1:7]], T.StructField("groups", T.StringType())])
    if with_links:
        schema.add("links", T.DataType.fromDDL(_LINK_SQL))

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own["pair"].to_numpy())
        known = {c: own[c].to_numpy()[order] for c in own.column_names}
        return pa.concat_tables([stretch(r, known) for r in rows.to_pylist()])

    def stretch(row: dict, known: dict[str, np.ndarray]) -> pa.Table:
        size_a, size_b = sizes(a, b)
        ids_a, ids_b = _spread(row["ids_a"]), _spread(row["ids_b"])
        upto_a, upto_b = np.cumsum(row["n_a"]), np.cumsum(row["n_b"])
        end_a = _ends(size_a, ids_a)
        m = Merge(end_a, _ends(size_b, ids_b))
        byte = np.append(0, end_a)[upto_a]
        links, groups = np.searchsorted(m.end, byte, "right"), np.searchsorted(m.group_end, byte, "right")
        at = np.searchsorted(known["pair"], ids_a[m.a].astype(np.int64) << 16 | ids_b[m.b])
        n, best = known["docs"][at], known["best_a"][at]
        upto = lambda x: np.append(0, np.cumsum(x, dtype=np.int64))[links]
        each = lambda x: pa.array(np.diff(np.append(0, x)), pa.int64())
        cols = [pa.array(row["ids"], pa.string()), *map(each, (upto_a, upto_b, groups, links, upto(best), upto(n))), pa.array(written(m, ids_a, ids_b, upto_a + upto_b), pa.string())]
        if with_links:
            doc = np.searchsorted(links, np.arange(len(m.end)), "right")
            before = np.append(0, byte)[doc]
            start = np.append(0, m.end[:-1])[: len(m.end)]
            parts = [ids_a[m.a].astype(np.int32), ids_b[m.b].astype(np.int32), start - before, m.end - before, n, best, known["best_b"][at]]
            flat = pa.StructArray.from_arrays([pa.array(x) for x in parts], fields=list(_LINK))
            cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, links), pa.int32()), flat))
        return pa.Table.from_arrays(cols, names)

    left = kept.where("ids_a is not null").select("block", "ids", "n_a", "n_b", "ids_a", "ids_b")
    found = left.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, schema)
    return found.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType)), counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over all documents; groups as a digest."""
    import public_tokenizers

    found, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {"op11_alignment": op11_alignment}
ORACLE_SQL: dict[str, str] = {}
