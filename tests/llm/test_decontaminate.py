import random
import re

import pytest
from abacist.llm import decontaminate as D
from compare import same

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(item, w[s : s + n]) for s in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for item, x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    own |= {item} - {None}
        out.append((doc, len(w), len(hit), tuple(sorted(own))))
    return sorted(out, key=repr)


def found(docs, items, **more):
    rows = D.contamination(docs, items, **more).collect()
    texts = [r.text for r in docs.collect()]
    for r in rows:
        assert sum(s.words for s in r.spans) == r.n_hit
        for s in r.spans:  # the bytes of a span are its words
            assert any(words((t or "").encode()[s.first_byte : s.first_byte + s.bytes].decode(errors="replace")) == words(t)[s.first_word : s.first_word + s.words] for t in texts)
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in rows), key=repr)


def test_query_against_sql(spark, small, duck):
    same(D.op13_decontaminate(spark, small), duck.sql(D.ORACLE_SQL["op13_decontaminate"]))


@pytest.mark.parametrize("limits", [(D.PART_BYTES, D.SLICE), (200, 300)])
def test_against_all_windows(spark, monkeypatch, limits):
    """Few words, so that windows overlap, repeat and touch text borders; the benchmark in one part or many."""
    for name, x in zip(("PART_BYTES", "SLICE"), limits):
        monkeypatch.setattr(D, name, x)
    rng = random.Random(2)
    some = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    v = ["a", "B", "ça", "É", "x1", "漢"]
    items = [(i, some(rng.randrange(1, 14), v)) for i in range(12)] + [(50, "a a a a a a a a a a a a"), (51, "a, a! a"), (52, None), (53, " .,"), (None, "only here by name of none"), (3, "repeated id with words of its own here and there too")]
    docs = [(i, some(rng.randrange(0, 60), v)) for i in range(40)] + [(100, "a " * 80), (101, "x. Only-here by_name of (none)!"), (102, "there too repeated id with words of its own here and there too"), (103, None), (104, ""), (105, "...")]
    docs += [(200 + i, items[i][1]) for i in range(12)] + [(7, docs[7][1])] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert found(d, i) == brute(docs, items)
    assert found(d, i, window=4, shingle=2) == brute(docs, items, 4)


def test_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([("q1", "The QUICK brown fox", 1), ("q2", "", 2), (None, None, 3)], "item_id string, text string, window int")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = found(odd_docs, items)
    assert got == brute(rows, [("q1", "the quick brown fox")])
    assert found(odd_docs, items.where("false")) == brute(rows, [])
    assert found(no_docs, items) == []


def test_equal_hashes_cost_a_comparison_only(spark, monkeypatch):
    """With every word under one hash, each shingle looks alike and the words decide."""
    import numpy as np

    w = D.Words.of(__import__("pyarrow").array(["one two three four", "five six"]))
    monkeypatch.setattr(D.Words, "hashes", lambda self: np.zeros(len(self.start), dtype=np.uint64))
    index = D.Index(__import__("pyarrow").table({"shingle": [int(w.shingles(w.hashes(), 2).view(np.int64)[0])] * 2, "at": [0, 1], "n_words": [2, 3], "window": ["two three", "three four five"], "items": [[1], [2]]}), 2)
    first, win = index.places(w, D.Sieve(index.key))
    assert list(zip(first.tolist(), win.tolist())) == [(1, 0)]
