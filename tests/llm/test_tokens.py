import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from abacist.llm import packing, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def whole(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(e.ids, dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'st Éß \n\t  \x1c\x85  1!?.,<|endoftext|>Σςσ́K")) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_pieces_equal_whole_texts(path, texts):
    got = tokens.encode(texts, path)
    assert [np.frombuffer(g, dtype="<u2").tolist() for g in got] == [w.tolist() for w in whole(path, texts)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=50))
def test_format_round_trip(ranks):
    control, data = tokens.pack_ranks(np.array(ranks, dtype="<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert tokens.unpack_ranks(control, data, len(ranks)).tolist() == ranks


def expected(path, rows, end):
    return [(i, np.append(x, end).astype("<u4")) for (i, _), x in zip(rows, whole(path, [r[1] for r in rows]))]


def test_op2(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for i, x in expected(BYTES, rows, 2):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in tokens.op2_token_output(spark, small).collect()) == want


def test_op2_odd_rows(spark, odd_docs, no_docs):
    written, ranks = tokens.write_blocks(odd_docs, BYTES, end_id=2, partitions=3)
    rows = sorted(tokens.read_blocks(written, ranks, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    want = {bytes(x.tobytes()) for _, x in expected(BYTES, [(r.doc_id, r.text) for r in odd_docs.collect()], 2)}
    assert {bytes(r.ids) for r in rows} == want
    counts = np.bincount(np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in rows]), minlength=1)
    assert counts[ranks].tolist() == sorted(counts[counts > 0].tolist(), reverse=True)
    assert tokens.read_blocks(*tokens.write_blocks(no_docs, BYTES, end_id=2)).count() == 0


def test_another_session_decodes(spark, small, tmp_path):
    """The folder alone is enough: ranks and blocks are read back through a session that did not write them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tokens.write_blocks(docs, BYTES, end_id=2, path=f"{tmp_path}/ids")
    other = spark.newSession()
    rows = {r.doc_id: r for r in tokens.read_blocks(*tokens.open_blocks(other, f"{tmp_path}/ids"), with_ids=True).collect()}
    for i, x in expected(BYTES, [tuple(r) for r in docs.select("doc_id", "text").collect()], 2):
        assert bytes(rows[i].ids) == x.tobytes() and rows[i].n_tokens == len(x)


def test_a_small_memory_changes_nothing(monkeypatch, spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = [x.astype("<u2").tobytes() for x in whole(BYTES, texts)]
    encoder = tokens.Encoder(BYTES)
    monkeypatch.setattr(tokens, "REMEMBERED", 3000)
    for i in range(0, len(texts), 20):
        ids, n = encoder.encode(tokens.pa.array(texts[i : i + 20], tokens.pa.string()))
        assert [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] == want[i : i + 20]
        assert encoder.runs.nbytes < 3_000_000


def check_packing(pieces, docs):
    """Every id in exactly one piece, no gap in a sequence, padding in the last one only."""
    by_seq, by_doc = {}, {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for k, v in by_seq.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or k == max(by_seq) and at < 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    ids = dict(docs)
    for (i, n), v in by_doc.items():
        assert n == len(ids[i])
        got = sorted((r.start, r.length, r.ids_crc32) for r in v)
        assert sum(x[1] for x in got) % n == 0
        for start, length, crc in got:
            assert crc == zlib.crc32(ids[i][start : start + length].tobytes())


def test_op3(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    pieces = packing.op3_packing(spark, small).collect()
    docs = expected(WORDS, rows, 1)
    check_packing(pieces, docs)
    assert sum(r.length for r in pieces) == sum(len(x) for _, x in docs)


def test_op3_odd_rows(odd_docs, no_docs):
    docs = expected(WORDS, [(r.doc_id, r.text) for r in odd_docs.collect()], 1)
    for parts in (1, 4):
        pieces = packing.pack(odd_docs.repartition(parts), WORDS, with_ids=True).collect()
        check_packing(pieces, docs)
        assert sum(r.length for r in pieces) == sum(len(x) for _, x in docs)
    assert packing.pack(no_docs, WORDS).count() == 0


def test_padding_to_a_power_of_two(spark):
    one = spark.createDataFrame([(1, "a " * 63)], "doc_id long, text string")
    assert [r.padded for r in packing.pack(one, WORDS).collect()] == [64]
    two = spark.createDataFrame([(1, "a " * 64)], "doc_id long, text string")
    assert [r.padded for r in packing.pack(two, WORDS).collect()] == [2048]


def test_small_batches_bound_rows_and_restore_the_setting(spark):
    from abacist.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark, 10):
        count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)
        rows = [r.n for r in spark.range(0, 95, 1, 1).mapInArrow(count, "n long").collect()]
    assert sum(rows) == 95 and max(rows) <= 10 and spark.conf.get(key) == before
