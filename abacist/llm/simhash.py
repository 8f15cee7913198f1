"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into the fewest segments for which two fingerprints at the allowed distance
must agree in one segment up to a single bit (distance // 2 + 1 of them).  Each segment is indexed
under all its variants with one bit masked, so two fingerprints that are close meet in an equality
group; there the full Hamming distance is verified and only a spanning forest of the verified
links is kept: the groups lose no link between components, yet never emit all pairs.

Equal fingerprints are collapsed before the index is built, so thousands of copies cost one row.
A group beyond ``BLOCK`` fingerprints is dealt out as pairs of blocks, exactly, over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import discard, sliced, staged, table

#: Fingerprints of one index group that are compared inside one task.
BLOCK = 4096
#: Runs up to this length are compared by shifts over the whole Arrow batch.
SHORT = 32
SEED = 42
#: Bits of an index key that hold the segment; its number is above them.
KEY_BITS = 32


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(offset, width) of each segment of one 64-bit word."""
    n = distance // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


# ---------------------------------------------------------------- fingerprints
def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Word k-grams with repeats; the whole sequence if shorter; none without words."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    joined = b" ".join(words)
    return [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, words: int) -> list[int]:
    """Signed 64-bit words whose bits are set in over half the rows of ``hashes`` (n x words uint64)."""
    n = len(hashes)
    counts = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)]).view(np.uint8).reshape(-1, 8 * words)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view(np.int64).tolist()


def shingle_fingerprint(text: bytes | None, k: int) -> list[int]:
    parts = shingles(text.lower().split(), k) if text else []
    if not parts:
        return [0]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(p, SEED) for p in parts], dtype=np.uint64), 1)


def word_set_fingerprint(text: bytes | None) -> list[int]:
    """128 bits over the set of words; edits of single words move it less than shingles do."""
    words = set(text.lower().split()) if text else ()
    if not words:
        return [0, 0]
    digest = xxhash.xxh3_128_digest
    return majority(np.frombuffer(b"".join([digest(w) for w in words]), dtype=np.uint64).reshape(-1, 2), 2)


def fingerprints(docs: DataFrame, *, shingle: int = 4, kind: str = "shingles", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, h (digest of the exact text), f0[, f1]``, one row per input row.  Null text counts as empty."""
    width = 1 if kind == "shingles" else 2
    fields = [f"f{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [shingle_fingerprint(t, shingle) if kind == "shingles" else word_set_fingerprint(t) for t in texts]
            h = [hashlib.md5(t or b"").digest() for t in texts]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.binary()), *cols], ["id", "h", *fields])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.BinaryType()), *[T.StructField(f, T.LongType()) for f in fields]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- spanning links inside equality groups
def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1)


def forest(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Minimum spanning forest (Prim) of the links at ``limit`` bits or fewer; fp is n x words uint64."""
    n = len(fp)
    best, near, out = np.full(n, 1 << 20), np.zeros(n, dtype=np.int64), []
    left = np.ones(n, dtype=bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        best[at] = 1 << 21
        d = _distance(fp ^ fp[at])
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], at
        at = int(best.argmin())
        if best[at] <= limit:
            out.append((int(near[at]), at))
    return out


def _trees(links: np.ndarray, vid: np.ndarray) -> list[list[int]]:
    """The vids of each tree of a forest; those without a link are in none."""
    label = np.arange(len(vid))
    member: dict[int, list[int]] = {}
    for a, b in links.tolist():
        x, y = sorted((int(label[a]), int(label[b])), key=lambda k: len(member.get(k, (k,))))
        moved = member.pop(x, [x])
        label[moved] = y
        member.setdefault(y, [y]).extend(moved)
    return [vid[t].tolist() for t in member.values()]


def _canonical(x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Of pairs with xor ``x`` (n x words): the number of the first index key that both share."""
    out = np.full(len(x), -1, dtype=np.int64)
    for w in range(x.shape[1]):
        for s, (off, width) in enumerate(cuts):
            part = (x[:, w] >> np.uint64(off)) & np.uint64((1 << width) - 1)
            hit = (out < 0) & (np.bitwise_count(part) <= 1)
            pos = np.where(part > 0, np.log2(np.maximum(part, 1).astype(np.float64)), 0).astype(np.int64)
            out = np.where(hit, (w * len(cuts) + s) * 64 + pos, out)
    return out


def _links(batches: Iterator[pa.RecordBatch], limit: int, width: int, cuts: list[tuple[int, int]], block: int, short_run: int, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted (key, vid, f...) rows -> links (a, b), or, of every group beyond ``block``, its rows (key, vid, f...).

    A link comes out under the first key that its ends share and under no other: the ends of one that is
    left out are joined by the forest of that earlier key, so the components stay the same.
    With ``keep`` each tree of a forest that stands in for a group comes out as well: a row with the key and the tree's vids.
    """
    names = ["a", "b", "hot", *[f"f{i}" for i in range(width)], "tree"]

    def pack(a, b, hot=None, fp=None, tree=None) -> pa.RecordBatch:
        n = len(a)
        none = [pa.nulls(n, pa.int64())] * width
        trees = pa.nulls(n, pa.list_(pa.int64())) if tree is None else pa.array(tree, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if hot is None else pa.array(hot, pa.int64()), *(none if fp is None else [pa.array(fp[:, i].view(np.int64)) for i in range(width)]), trees], names)

    def solve(key: np.ndarray, vid: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([edge, [len(key)]]))
        run = np.repeat(np.arange(len(edge)), size)
        number = key >> KEY_BITS
        short = size[run] <= min(short_run, block)
        found: list[np.ndarray] = []
        for k in range(1, short_run):
            i = np.flatnonzero((run[k:] == run[:-k]) & short[:-k]) if k < len(run) else ()
            if not len(i):
                break
            x = fp[i] ^ fp[i + k]
            ok = _distance(x) <= limit
            i, x = i[ok], x[ok]
            own = _canonical(x, cuts) == number[i] if len(i) else ()
            found.append(np.stack([i[own], i[own] + k], axis=1) if len(i) else np.empty((0, 2), dtype=np.int64))
        pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        if len(pairs):
            crowded = np.bincount(run[pairs[:, 0]], minlength=len(size)) >= size
            plain = pairs[~crowded[run[pairs[:, 0]]]]
            yield pack(vid[plain[:, 0]], vid[plain[:, 1]])
        else:
            crowded = np.zeros(len(size), dtype=bool)
        for r in np.flatnonzero((size > min(short_run, block)) | crowded):
            at = slice(edge[r], edge[r] + size[r])
            if size[r] > block:
                yield pack(vid[at], np.zeros(size[r], dtype=np.int64), key[at], fp[at])
                continue
            links = np.array(forest(fp[at], limit), dtype=np.int64).reshape(-1, 2)
            own = links[_canonical(fp[at][links[:, 0]] ^ fp[at][links[:, 1]], cuts) == number[edge[r]]]
            yield pack(vid[at][own[:, 0]], vid[at][own[:, 1]])
            if keep and len(links):
                trees = _trees(links, vid[at])
                yield pack([t[0] for t in trees], np.ones(len(trees), dtype=np.int64), np.full(len(trees), key[edge[r]]), tree=trees)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    hot: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, vid = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        fp = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1).view(np.uint64)
        if hot is not None:
            n = int(np.searchsorted(key, hot, side="right"))
            if n:
                yield pack(vid[:n], np.zeros(n, dtype=np.int64), np.full(n, hot), fp[:n])
            if n == len(key):
                continue
            hot, key, vid, fp = None, key[n:], vid[n:], fp[n:]
        if held:
            key, vid, fp = (np.concatenate([h[i] for h in held] + [x]) for i, x in enumerate((key, vid, fp)))
            held = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from solve(key[:last], vid[:last], fp[:last])
        key, vid, fp = key[last:], vid[last:], fp[last:]
        if len(key) > block:
            hot = int(key[0])
            yield pack(vid, np.zeros(len(vid), dtype=np.int64), key, fp)
        else:
            held = [(key, vid, fp)]
    if held:
        yield from solve(*held[0])


def spanning_links(uniq: DataFrame, limit: int, width: int, cuts: list[tuple[int, int]], *, block: int | None = None, short: int | None = None) -> DataFrame:
    """Links (a, b) between ``uniq`` rows (vid, f0[, f1]) whose components are those of all links found."""
    return _index_links(uniq, limit, width, cuts, block=block, short=short)[0]


def _index_links(uniq: DataFrame, limit: int, width: int, cuts: list[tuple[int, int]], *, block: int | None = None, short: int | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spanning links, and with ``keep`` the trees (key, vids) of the groups not all of whose pairs are among them."""
    block, short = block or BLOCK, short or SHORT
    fields = [f"f{i}" for i in range(width)]
    keys = [
        (F.lit(((w * len(cuts) + s) * 64 + p) << KEY_BITS) + (F.shiftrightunsigned(f"f{w}", off).bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << p))))).cast("long")
        for w in range(width)
        for s, (off, n) in enumerate(cuts)
        for p in range(n)
    ]
    keyed = uniq.select(F.explode(F.array(*keys)).alias("key"), "vid", *fields)
    schema = "a long, b long, hot long, " + ", ".join(f"{f} long" for f in fields) + ", tree array<long>"
    found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _links(it, limit, width, cuts, block, short, keep), schema), "links")
    cut = found.where(F.col("hot").isNotNull())
    rest = cut.where("b = 0").select(F.col("hot").alias("key"), F.col("a").alias("vid"), *fields)
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block // 2)).cast("int").alias("m"))
    dealt = rest.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("vid"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))

    def pair(pdf):
        import pandas as pd

        fp = np.stack([pdf[f].to_numpy() for f in fields], axis=1).view(np.uint64)
        links = np.array(forest(fp, limit), dtype=np.int64).reshape(-1, 2)
        links = links[_canonical(fp[links[:, 0]] ^ fp[links[:, 1]], cuts) == pdf["key"].iloc[0] >> KEY_BITS]
        vid = pdf["vid"].to_numpy()
        return pd.DataFrame({"a": vid[links[:, 0]], "b": vid[links[:, 1]]})

    more = dealt.groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).applyInPandas(pair, "a long, b long")
    links = found.where(F.col("hot").isNull()).select("a", "b")
    large = rest.groupBy("key", "vid").agg(F.array("vid").alias("tree")).drop("vid")
    return (links.unionByName(more) if not rest.isEmpty() else links).distinct(), cut.where("b = 1").select(F.col("hot").alias("key"), "tree").unionByName(large)


# ---------------------------------------------------------------- pairs that a forest leaves out
#: Bits of the parity bitmap of a set: as many bits as two bitmaps differ in, the sets differ in elements, at least.
PARITY = 1024


def parity(hashes: np.ndarray) -> bytes:
    return np.packbits(np.bincount(hashes & (PARITY - 1), minlength=PARITY) & 1).tobytes()


def _open_pairs(batches: Iterator[pa.RecordBatch], limit: int, similarity: float, cuts: list[tuple[int, int]], cap: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, lo, hi, own, vid, root, size, bits, f0, f1) rows -> pairs (a, b) of one group and two roots.

    They are candidates under their first shared key (under any, if the key is negative), and neither set sizes nor bitmaps exclude the
    similarity.  A row with over ``cap`` such pairs to one root gives the ``cap`` closest, and a row with ``more``.
    """

    def solve(key: int, within: bool, own, vid, root, size, bits, fp) -> Iterator[pa.RecordBatch]:
        a, b, capped = [], [], []
        for i in range(len(vid) - 1):
            j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (within | (own[i + 1 :] != own[i])))
            x = fp[j] ^ fp[i]
            ok = _distance(x) <= limit
            j, x = j[ok], x[ok]
            if not len(j):
                continue
            apart = _distance(bits[j] ^ bits[i])
            ok = np.maximum(apart, np.abs(size[j] - size[i])) <= (size[j] + size[i]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            j, x, apart = j[ok], x[ok], apart[ok]
            first = _canonical(x, cuts)
            ok = first == key >> KEY_BITS if key >= 0 else first >= 0
            j, apart = j[ok], apart[ok]
            if len(j) > cap:
                order = np.lexsort((apart, root[j]))
                j = j[order]
                first = np.concatenate([[True], root[j][1:] != root[j][:-1]])
                at = np.arange(len(j))
                near = at - np.maximum.accumulate(np.where(first, at, 0)) < cap
                if not near.all():
                    capped.append(i)
                j = j[near]
            a.append(np.full(len(j), vid[i]))
            b.append(vid[j])
        if a:
            more = vid[np.array(capped, dtype=np.int64)]
            a, b = np.concatenate([*a, more]), np.concatenate([*b, more])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.arange(len(a)) >= len(a) - len(more))], ["a", "b", "more"])

    held: pa.Table | None = None

    def runs(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        ids = np.stack([t.column(i).to_numpy() for i in range(3)], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
        stop = [*edge[1:].tolist(), len(ids)]
        cols = [t.column(i).to_numpy() for i in (3, 4, 5, 6)]
        bits = np.frombuffer(b"".join(t.column(7).to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        fp = np.stack([t.column(i).to_numpy() for i in (8, 9)], axis=1).view(np.uint64)
        for n, (i, k) in enumerate(zip(edge.tolist(), stop)):
            if n == len(edge) - 1 and not last:
                held = t.slice(i)
            else:
                yield from solve(int(ids[i, 0]), bool(ids[i, 1] == ids[i, 2]), *[c[i:k] for c in cols], bits[i:k], fp[i:k])

    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t, held = (t if held is None else pa.concat_tables([held, t])), None
            yield from runs(t, False)
    if held is not None:
        yield from runs(held, True)


def open_pairs(cut: DataFrame, rows: DataFrame, limit: int, similarity: float, cuts: list[tuple[int, int]], *, cap: int, block: int | None = None) -> DataFrame:
    """(a, b, more) of the groups ``cut`` (key, tree) that hold several roots; ``rows`` has (vid, root, size, bits, f0, f1)."""
    of = cut.select("key", F.explode("tree").alias("vid")).join(rows.select("vid", "root"), "vid")
    m = F.ceil(F.count("*") / F.lit((block or BLOCK) // 2)).cast("int").alias("m")
    several = of.groupBy("key").agg(m, F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "m")
    dealt = of.drop("root").join(several, "key").withColumn("own", F.pmod(F.xxhash64("vid"), F.col("m")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "vid").join(rows, "vid")
    dealt = dealt.select("key", "lo", "hi", "own", "vid", "root", "size", "bits", "f0", "f1")
    parts = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return parts.mapInArrow(lambda it: _open_pairs(it, limit, similarity, cuts, cap), "a long, b long, more boolean")


# ---------------------------------------------------------------- connected components
def components(links: DataFrame) -> DataFrame:
    """(vid, root): the smallest vid reachable, for every vid that has a link.

    Alternating large-star and small-star steps; each round is a written table, and hub vertices
    are met by joins that adaptive execution may split.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("vid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vid"), F.col("v").alias("root"))).distinct()
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "edges")
        discard(edges)
        edges = after


def _labels(uniq: DataFrame, links: DataFrame) -> DataFrame:
    """uniq with ``label``: the smallest ``rep`` of the row's component."""
    roots = components(links)
    joined = uniq.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    least = joined.groupBy("root").agg(F.min("rep").alias("label"))
    return joined.join(least, "root")


def simhash_components(docs: DataFrame, *, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and texts without words, have fingerprint zero and link like any other.
    Repeated rows and ids keep their rows; a null id takes part, and is never the smallest id unless
    its component has no other.  An empty table gives an empty result.  Extra columns are ignored.
    """
    fps = staged(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col).drop("h"), "fps")
    uniq = staged(fps.groupBy("f0").agg(F.min("id").alias("rep")).withColumn("vid", F.monotonically_increasing_id()), "uniq")
    labels = _labels(uniq, spanning_links(uniq, distance, 1, segments(distance))).select("f0", "label")
    out = fps.join(labels, "f0")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("label").alias("component_id"))


# ---------------------------------------------------------------- near-duplicate removal
def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, bits_apart: int = 32, cap: int = 4, block: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, rep, n, root): each distinct text (md5), its smallest id, the rows with that id, its group.

    Candidates: 128-bit SimHash over the set of words, met in six segments under one-bit-masked
    variants and verified at ``bits_apart`` bits.  A candidate link counts if the texts' sets of
    ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Jaccard does not follow the Hamming forest of a large group, so its links are a first round only.
    Further rounds verify the pairs of such groups that still lie in two components, ``cap`` to a row
    and component and more each round, until no candidate of two components is left unverified.
    """
    fps = staged(fingerprints(docs, kind="words", id_col=id_col, text_col=text_col), "fps")
    text_key = ["h", "f0", "f1"]
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("first")
    uniq = fps.groupBy(*text_key, "id").agg(F.count("*").alias("n")).groupBy(*text_key).agg(first)
    uniq = staged(uniq.select(*text_key, F.col("first.id").alias("rep"), F.col("first.n").alias("n"), F.monotonically_increasing_id().alias("vid")), "uniq")
    links, cut = _index_links(uniq, bits_apart, 2, segments(4), block=block, keep=True)
    links = staged(links, "candidates")
    used = links.select(F.col("a").alias("vid")).unionByName(links.select(F.col("b").alias("vid"))).distinct()
    wanted = uniq.join(used, "vid").select("vid", "rep", "h")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [sorted({xxhash.xxh64_intdigest(s, SEED) - (1 << 63) for s in shingles((t or b"").lower().split(), shingle)}) for t in texts]
            bits = [parity(np.array(s, dtype=np.int64)) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array([len(s) for s in found], pa.int64()), pa.array(bits, pa.binary())], ["vid", "s", "size", "bits"])

    held = staged(_with_text(docs, wanted, id_col, text_col).dropDuplicates(["vid"]).select("vid", "text").mapInArrow(sets, "vid long, s array<long>, size long, bits binary"), "sets")
    left, right = (held.select(F.col("vid").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")

    linked = staged(verified(links), "linked")
    known = held.select("vid", "size", "bits").join(uniq.select("vid", "f0", "f1"), "vid")
    none = cut.isEmpty()
    if not none:
        # a tree lies within one component of all candidate links: one with one root needs no second look, and one
        # that fits a block is compared as a whole, not under each of its keys
        near = staged(components(links).withColumnRenamed("root", "near"), "near")
        cut = staged(cut.withColumn("vid", F.col("tree")[0]).join(near, "vid").drop("vid"), "trees")
        crowded = cut.select("near").distinct()
    while True:
        roots = staged(components(linked), "roots")
        if none:
            break
        rows = known.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
        of = rows.join(near, "vid")
        mixed = of.groupBy("near").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"))
        mixed = mixed.where("least <> most").join(crowded, "near", "left_semi").select("near", (F.col("size") > (block or BLOCK)).alias("large"))
        small = of.join(mixed.where("not large"), "near").select((-1 - F.col("near")).alias("key"), F.array("vid").alias("tree"))
        large = cut.join(mixed.where("large"), "near", "left_semi").select("key", "tree")
        pairs = staged(open_pairs(large.unionByName(small), rows, bits_apart, similarity, segments(4), cap=cap, block=block), "pairs")
        if pairs.isEmpty():
            break
        linked = staged(linked.unionByName(verified(pairs.where("not more").select("a", "b"))), "linked")
        none, cap = pairs.where("more").isEmpty(), cap * 16
    return uniq.join(roots, "vid", "left").select("h", "rep", "n", F.coalesce("root", "vid").alias("root"))


def _digest(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _with_text(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (rep, h, ...) with the text of the rows it names."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(wanted, texts["id"].eqNullSafe(wanted["rep"]) & (_digest("text") == wanted["h"]))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest non-null id.

    Nulls and empty texts are copies of each other.  Rows that repeat id and text keep one row.
    All columns stay as they were; an empty table stays empty.
    """
    order = F.struct(F.col("rep").isNull(), "rep", "h", "n")
    best = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).groupBy("root").agg(F.min(order).alias("o"))
    keep = staged(best.select(F.col("o.rep").alias("__rep"), F.col("o.h").alias("__h"), F.col("o.n").alias("__n")), "keep")
    own = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), _digest(text_col).alias("__digest"))
    rows = own.join(keep, own["__id"].eqNullSafe(keep["__rep"]) & (own["__digest"] == keep["__h"]))
    if keep.where("__n > 1").isEmpty():
        return rows.select("__row.*")
    once = rows.where("__n > 1").dropDuplicates(["__rep", "__h"])
    return rows.where("__n = 1").unionByName(once).select("__row.*")


# ---------------------------------------------------------------- query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
