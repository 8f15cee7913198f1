"""Packing by concatenate and cut.

Documents are tokenised once and kept as id bytes in a scratch table together with their place in
the partition.  A first pass adds up the tokens of each partition, a prefix sum over the totals
gives every document its global offset, and a second pass cuts at the fixed windows.  A document
that crosses a boundary leaves one record per window; only the last sequence can hold padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import small_batches, staged, table
from abacist.llm.tokens import crc32_of, offsets, token_bytes

LENGTH = 2048


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, in_order: bool = False) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence, and a checksum.

    A null or empty text is its end id alone.  Repeated rows and ids are documents of their own.
    Every id lies in exactly one piece.  ``padded`` is the sequence's stored length: ``length``,
    unless the last sequence ends at a power of two.  With ``with_ids`` the ids come along.
    With ``in_order`` documents read back from files that Spark wrote keep the order of writing.
    """
    with small_batches(docs.sparkSession):
        kept = staged(token_bytes(docs, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, in_order=in_order), "ids", compression="zstd")
    before = offsets(kept, "n")
    total = kept.agg(F.sum("n")).first()[0] or 0
    last = total % length
    last_padded = last if last & (last - 1) == 0 and last else length
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")]]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            at = start + np.array([before[p] for p in part.tolist()])
            first, final = at // length, (at + n - 1) // length
            doc = np.repeat(np.arange(len(n)), final - first + 1)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(final - first + 1) - (final - first + 1), final - first + 1) + first[doc]
            start = np.maximum(seq * length - at[doc], 0)
            stop = np.minimum((seq + 1) * length - at[doc], n[doc])
            blobs = batch.column(4).to_pylist()
            ids = [np.frombuffer(b, dtype=np.uint16) for b in blobs]
            crc = [crc32_of(ids[d][a:b]) for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist())]
            padded = np.where(seq == total // length, last_padded, length)
            cols = [pc.take(batch.column(0), pa.array(doc)), *[pa.array(x, pa.int64()) for x in (start, stop - start, crc, n[doc], seq, at[doc] + start - seq * length, padded)]]
            if with_ids:
                cols.append(pa.array([ids[d][a:b].astype("<u4").tobytes() for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return kept.select("id", "part", "n", "start", "ids").mapInArrow(cut, T.StructType(fields))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_packing": op3_packing}
ORACLE_SQL: dict[str, str] = {}
