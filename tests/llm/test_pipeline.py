import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from abacist.llm import langid, packing, quality, simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, taken = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, small).cache()
        taken[name] = before, [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "packing":
            assert docs.columns == columns
    for name in ("language", "quality", "near_duplicates"):
        before, after = taken[name]
        assert len(after) == len(set(after)) and set(after) <= before
    assert len(set(taken["near_duplicates"][1])) < len(taken["near_duplicates"][0])
    assert set(taken["packing"][1]) == set(taken["mixing"][1]) <= set(taken["near_duplicates"][1])
    assert len(taken["mixing"][1]) > len(set(taken["mixing"][1]))


def test_run_equals_its_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    good = langid.keep_known(spark.read.parquet(f"{small}/documents.parquet"))
    kept = {r.doc_id for r in simhash.keep_one(quality.keep_good(good)).select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= kept
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) == 2048 for k, v in by.items() if k != max(by))


def test_empty_and_odd_tables(spark, odd_docs, no_docs, small):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
        docs.count()


def test_packing_follows_the_order_of_writing(spark, tmp_path):
    """Files of growing size, which Spark reads largest first: sequences follow the sorted order that was written."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id, ' '), cast(5 + id as int))").alias("text"))
    for most in (0, 40):
        path = f"{tmp_path}/{most}"
        docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", most).parquet(path)
        rows = packing.pack(spark.read.parquet(path), public_tokenizers.path("word_bpe_49k.json"), in_order=True).collect()
        order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
        assert order == sorted(order) and set(order) == set(range(600))
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
