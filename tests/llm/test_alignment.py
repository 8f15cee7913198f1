import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from abacist.llm import alignment
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokenised(text):
    """[(id, first byte, end byte)] of both sides, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}

    def sides(text):
        if not text:
            return None
        ids = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        raw = [[bytes(byte[c] for c in t.id_to_token(i)) for i in ids[0]], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if any(b"".join(x) != b" " + text.encode() for x in raw):
            return None
        out = []
        for i, r in zip(ids, raw):
            at, own = 0, []
            for k, x in zip(i, r):
                own.append((k, at, at + len(x)))
                at += len(x)
            out.append(own)
        return out

    return [sides(x) for x in text]


def brute(rows):
    found = tokenised([t for _, t in rows])
    links = [[(i, j, max(x, u), min(y, v)) for i, x, y in s[0] for j, u, v in s[1] if x < v and u < y] if s else [] for s in found]
    held = Counter(p for own in links for p in {x[:2] for x in own})
    best = [defaultdict(int), defaultdict(int)]
    for p, n in held.items():
        for side in (0, 1):
            best[side][p[side]] = max(best[side][p[side]], n)
    out = []
    for (doc, _), s, own in zip(rows, found, links):
        if not s:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({y for _, _, y in s[0]} & {y for _, _, y in s[1]})
        groups = [[",".join(str(k) for k, _, y in side if a < y <= b) for side in s] for a, b in zip([0, *cuts], cuts)]
        n = [held[x[:2]] for x in own]
        out.append((doc, len(s[0]), len(s[1]), len(cuts), len(own), sum(n[k] == best[0][x[0]] for k, x in enumerate(own)), sum(n), ";".join("|".join(g) for g in groups)))
    return out, links, held, best


ODD = ["<|endoftext|> <s> <0x41>", "▁ is no blank", " leading", "trailing ", "  two  blanks \n\n and\tmore\r\n", "漢字 😀 Ａ①ﬁ", "\x00a﻿​ b", " ", "\n", "é" * 50]
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def rows(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.collect() if not r.text or len(r.text) < 5000] + [((1 << 60) + 1 + i, t) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_against_all_token_pairs(spark, rows, monkeypatch, block):
    """Every group, link and count, in one block of documents or in many."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "SLICE", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected, links, held, best = brute(rows)
    found, pairs = alignment.align(docs, A, B, with_links=True)
    got = found.collect()
    assert sorted(repr(tuple(r[c] for c in NAMES)) for r in got) == sorted(map(repr, expected))
    every = sorted((x.a, x.b, x.first_byte, x.end_byte, x.docs, x.best_a, x.best_b) for r in got for x in r.links)
    assert every == sorted((i, j, x, y, n, n == best[0][i], n == best[1][j]) for own in links for i, j, x, y in own for n in [held[i, j]])
    assert {(r.a, r.b): r.docs for r in pairs.collect()} == held


def test_odd_tables(odd_docs, no_docs):
    got = alignment.align(odd_docs, A, B)[0]
    assert got.columns == NAMES and got.count() == odd_docs.count()
    empty, pairs = alignment.align(no_docs, A, B)
    assert empty.count() == pairs.count() == 0


def test_query_digests(spark, small):
    """The query's digests are those of the groups; its sums agree over the whole table."""
    got = alignment.op11_alignment(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert len(got) == docs.count()
    some = {r.doc_id: r.text for r in docs.where(F.length("text") < 400).collect()}
    expected = {r[0]: r for r in brute(list(some.items()))[0]}
    for r in got:
        assert r.n_links == r.n_a + r.n_b - r.n_groups and 0 <= r.n_best <= r.n_links <= max(r.count_sum, r.n_links)
        if r.doc_id in some:
            e = expected[r.doc_id]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == e[1:5]
            assert r.groups_sha256 == (hashlib.sha256(e[7].encode()).hexdigest() if e[1] else "")
