"""The pipeline's rows against loops over all documents: no shared code but the list of ranked n-grams and the tables' SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers

import corpus_pipeline
from abacist.llm import langid, mixing, quality

TINY = "/root/testdata/sf0.001"


def known(docs):
    """Documents whose ranked n-grams come near some language's, learned from the labels of four fifths."""
    counts = {}
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5:
            counts.setdefault(d["lang"], Counter()).update(langid.grams(d["text"]).tolist())
    rank = lambda c: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[: langid.RANKS])}
    place = {lang: rank(c) for lang, c in counts.items()}
    out = []
    for d in docs:
        own = rank(Counter(langid.grams(d["text"]).tolist()))
        if own:
            away = min(sum(abs(at[g] - i) if g in at else langid.RANKS for g, i in own.items()) for at in place.values())
            if 1 - away / (len(own) * langid.RANKS) >= 0.1:
                out.append(d)
    return out


def asked(sql, docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs))
    return con.sql(sql).fetchdf().to_dict("records")


def one_of_each(docs):
    """The smallest id of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"]))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(docs):
        if find(i) not in best or d["doc_id"] < best[find(i)]["doc_id"]:
            best[find(i)] = d
    return list(best.values())


def test_rows_against_loops(spark):
    from tokenizers import Tokenizer

    docs = [r.asDict() for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    docs = known(docs)
    kept = {r["doc_id"] for r in asked(quality.OP5_SQL, docs) if r["kept"]}
    docs = one_of_each([d for d in docs if d["doc_id"] in kept])
    copies = {r["doc_id"]: round(r["taken"] / r["size"]) for r in asked(mixing.OP1_SQL, docs) if r["taken"]}
    text = {d["doc_id"]: d["text"] for d in docs}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(text[i], add_special_tokens=False).ids, 1] for i in copies}

    rows = [r.asDict() for r in corpus_pipeline.run(spark, TINY).collect()]
    starts = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert starts == Counter(copies) and len(copies) > 50
    covered = Counter()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        piece = np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert covered == Counter({(i, k): n for i, n in copies.items() for k in range(len(ids[i]))})
    # sequences are full and gapless but for the end of the last
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(by) == list(range(len(by))) and all(n == 2048 for k, n in by.items() if k != max(by))
