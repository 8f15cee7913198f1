"""Hard-negative mining by bit-sliced integer products.

Vectors become integers, and blocks of rows are kept as bit-planes: plane j holds bit j of every
component (an offset makes them all non-negative).  A tile of anchors is multiplied with the planes of
a block, most significant first.  After each plane every score lies in an interval: what is known, plus
what the lower planes may add on the anchor's negative and positive components.  A row is dropped once
its interval lies outside every score window of the anchor, or below the scores of as many rows as are
asked for.  While many rows are left a plane is one matrix product, afterwards only pairs that are left
are looked at; what remains after the last plane has its exact score.

The anchors are a stated query set that is held against all rows in blocks: groups of row blocks meet
groups of anchor blocks in tasks of bounded size, each hands on its best rows, and a window over these
picks the best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.common import staged, table

#: Rows of a block of bit-planes, anchors of a block, and of a tile that is multiplied at once.
ROWS, ANCHORS, TILE = 4096, 2048, 256
#: Blocks of rows, and of anchors, that one task takes.
ROW_BLOCKS, ANCHOR_BLOCKS = 32, 4
#: Pairs are looked at one by one when less than one in so many is left.
SPARSE = 32
#: Pairs whose components are gathered at once.
GATHER = 1 << 16
#: Beyond every score.
FAR = 1 << 62


def integers(rows: DataFrame, *, anchors: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, anchor, q): the rows that take part, with components floor(scale * x)."""
    double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    return some.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(double, lambda x: F.floor(x * scale)).alias("q"))


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of a matrix; shorter ones end in zeros."""
    n = q.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(q), width), dtype=np.int64)
    out[np.arange(width) < n[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(rows: DataFrame, size: int, width: int, bits: int | None, windows: bool = False) -> DataFrame:
    """Rows in blocks: (part, block, rows, ids, labels, data) with bit-planes, or integers if ``bits`` is None."""
    names = ["part", "block", "rows", "ids", "labels", "data"] + ["windows"] * windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, block = TaskContext.get().partitionId(), [], 0, 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            m = _matrix(t["q"].combine_chunks(), width)
            if bits is not None:
                m += 1 << (bits - 1)
                data = b"".join(np.packbits((m >> j & 1).astype(bool)).tobytes() for j in reversed(range(bits)))
            else:
                data = m.tobytes()
            cols = [pa.array([part]), pa.array([block]), *[_one_list(t[c]) for c in ("row", "id", "label")], pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols + [_one_list(t[c]) for c in ["scores"] * windows], names)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield flush(t.slice(0, size))
                held, n, block = t.slice(size).to_batches(), n - size, block + 1
        if n:
            yield flush(pa.Table.from_batches(held))

    schema = "part long, block long, rows array<long>, ids array<long>, labels array<long>, data binary" + ", windows array<array<long>>" * windows
    return rows.select("row", "id", "label", "q", *["scores"] * windows).mapInArrow(run, schema)


def _one_list(column: pa.ChunkedArray) -> pa.Array:
    values = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _planes(data: bytes, n: int, width: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(j, rows x components of zeros and ones), most significant bit first."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(bits, -1)
    for k in range(bits):
        yield bits - 1 - k, np.unpackbits(raw[k], count=n * width).reshape(n, width)


def narrowed(a: np.ndarray, data: bytes, n: int, bits: int, alive: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of all pairs that may still be among the ``k`` best of one of the anchor's windows.

    ``alive``: pairs to look at; ``low``, ``high``: anchors x windows; ``floor``: a score that ``k`` rows are known
    to reach, raised as intervals tighten.
    """
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    known = np.repeat(-(2 ** (bits - 1)) * a.sum(1)[:, None], n, axis=1)
    pairs = None
    for j, plane in _planes(data, n, a.shape[1], bits):
        rest = 2**j - 1
        if pairs is None:
            known += (a @ plane.T.astype(a.dtype)) * 2**j
            top, bottom = known + rest * up[:, None], known + rest * down[:, None]
            keep = np.zeros_like(alive)
            for w in range(low.shape[1]):
                if n > k and (floor[:, w] == -FAR).any():
                    sure = np.where(alive & (bottom >= low[:, w, None]) & (top <= high[:, w, None]), bottom, -FAR)
                    floor[:, w] = np.maximum(floor[:, w], np.partition(sure, n - k, axis=1)[:, n - k])
                keep |= (top >= np.maximum(low, floor)[:, w, None]) & (bottom <= high[:, w, None])
            alive = alive & keep
            if np.count_nonzero(alive) * SPARSE <= alive.size or j == 0:
                pairs = np.nonzero(alive)
                score = known[pairs]
        else:
            x, r = pairs
            for s in range(0, len(x), GATHER):
                score[s : s + GATHER] += np.einsum("ij,ij->i", a[x[s : s + GATHER]], plane[r[s : s + GATHER]].astype(a.dtype)) * 2**j
            top, bottom = score + rest * up[x], score + rest * down[x]
            keep = ((top[:, None] >= np.maximum(low, floor)[x]) & (bottom[:, None] <= high[x])).any(1)
            pairs, score = (x[keep], r[keep]), score[keep]
    if pairs is None:  # no component at all: every score is zero
        pairs = np.nonzero(alive)
        score = known[pairs]
    return *pairs, score


_BEST = "anchor_row long, anchor_id long, anchor_label long, window int, id long, row long, score long"
_BEST_NAMES = ["anchor_row", "anchor_id", "anchor_label", "window", "id", "row", "score"]


def _first(key: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each key: higher score, then smaller id (null last), then row."""
    order = np.lexsort((rows, ids, no_id, -score, key))
    sorted_key = key[order]
    begins = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def best(blocks: DataFrame, anchors: DataFrame, *, same_label: bool, k: int, width: int, bits: int, exact: type, shares: tuple[int, int]) -> DataFrame:
    """For each anchor and score window the first ``k`` rows of the same, or of another, label."""
    n_rows, n_anchors = shares
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("part", "block"), F.lit(n)))
    left = deal(blocks, n_rows, "r").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)).cast("array<long>")))
    right = deal(anchors, n_anchors, "a").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<long>")))

    def tile(own: dict, rows: list[dict], s: slice) -> pa.Table:
        a, labels, me = own["q"][s].astype(exact), own["labels"][s], own["rows"][s]
        low, high = own["low"][s].astype(exact), own["high"][s].astype(exact)
        windows = low.shape[1]
        floor = np.full(low.shape, -FAR, dtype=exact)
        state = [np.zeros(0, dtype=np.int64) for _ in range(5)]  # key, score, without id, id, row
        for b in rows:
            alive = (labels[:, None] == b["labels"]) == same_label
            alive &= me[:, None] != b["rows"]
            alive &= (low <= high).any(1)[:, None]
            if not alive.any():
                continue
            x, r, score = narrowed(a, b["data"], len(b["rows"]), bits, alive, low, high, floor, k)
            score = score.astype(np.int64)
            at, w = np.nonzero((score[:, None] >= own["low"][s][x]) & (score[:, None] <= own["high"][s][x]))
            fresh = [x[at] * windows + w, score[at], b["no_id"][r[at]], b["ids"][r[at]], b["rows"][r[at]]]
            state = [np.concatenate(c) for c in zip(state, fresh)]
            keep = _first(*state, k)
            state = [c[keep] for c in state]
            full = np.flatnonzero(np.bincount(state[0], minlength=floor.size) == k)
            last = np.searchsorted(state[0], full, "right") - 1
            floor.reshape(-1)[full] = np.maximum(floor.reshape(-1)[full], state[1][last])
        key, score, no_id, ids, row = state
        x = key // windows
        cols = [pa.array(me[x]), pa.array(own["ids"][s][x], mask=own["no_id"][s][x]), pa.array(labels[x]), pa.array((key % windows).astype(np.int32)), pa.array(ids, mask=no_id.astype(bool)), pa.array(row), pa.array(score)]
        return pa.Table.from_arrays(cols, _BEST_NAMES)

    def plain(t: pa.Table, i: int) -> dict:
        out = {c: t[c][i].values.fill_null(0).to_numpy(zero_copy_only=False) for c in ("rows", "ids", "labels")}
        return out | {"no_id": t["ids"][i].values.is_null().to_numpy(zero_copy_only=False), "data": t["data"][i].as_py()}

    def run(row_blocks: pa.Table, anchor_blocks: pa.Table) -> pa.Table:
        rows, out = [plain(row_blocks, i) for i in range(row_blocks.num_rows)], []
        for i in range(anchor_blocks.num_rows if rows else 0):
            own = plain(anchor_blocks, i)
            own["q"] = np.frombuffer(own["data"], dtype=np.int64).reshape(-1, width)
            if "windows" in anchor_blocks.column_names:
                lists = anchor_blocks["windows"][i].as_py()
                deep = max(map(len, lists))
                own["low"], own["high"] = (np.array([[w[e] for w in _pairs(x)] + [(FAR, -FAR)[e]] * (deep // 2 - len(x) // 2) for x in lists], dtype=np.int64) for e in (0, 1))
            else:
                own["low"], own["high"] = np.full((len(own["q"]), 1), -FAR), np.full((len(own["q"]), 1), FAR)
            out += [tile(own, rows, slice(s, s + TILE)) for s in range(0, len(own["q"]), TILE)]
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int32() if n == "window" else pa.int64()) for n in _BEST_NAMES})

    found = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, _BEST)
    order = Window.partitionBy("anchor_row", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pairs(x: list[int]) -> list[tuple[int, int]]:
    return list(zip(x[::2], x[1::2]))


def mine(rows: DataFrame, *, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of each anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors.  Components become floor(``scale`` * x), scores are integer inner products;
    a vector shorter than the longest counts as if it ended in zeros.  An anchor's positives are its first ``positives``
    other rows of its label; for each, the first ``negatives`` rows of another label whose score lies from ``low`` to
    ``high`` per cent of the positive's.  Higher scores come first, ties by smaller id, a null id last.

    Rows with a null label, a null vector, or a null or non-finite component take no part.  Repeated rows, and rows that
    repeat an id, are rows of their own.  Of an empty table nothing comes out.  Only the three columns are read.  Scores
    that might not fit a 64-bit integer are refused.
    """
    kept = staged(integers(rows, anchors=anchors, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col), "vectors")
    size = kept.agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(F.size("q")).alias("width"), F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    width, most = size["width"] or 0, int(size["most"] or 0)
    bits = (most + 1).bit_length() + 1
    reach = max(width, 1) * (1 << bits) * (most + 1)
    if reach * max(100, abs(low), abs(high)) >= FAR:
        raise ValueError("a score may not fit a 64-bit integer; take a smaller scale")
    exact = np.float64 if reach < 1 << 52 else np.int64
    parallel = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_anchors = max(1, -(-(size["anchors"] or 0) // (ANCHORS * ANCHOR_BLOCKS)))
    by_rows = max(1, math.ceil(size["n"] / (ROWS * ROW_BLOCKS)), min(-(-size["n"] // ROWS), -(-parallel // by_anchors)))
    common = {"width": width, "bits": bits, "exact": exact, "shares": (by_rows, by_anchors)}
    blocks = staged(_blocks(kept, ROWS, width, bits), "planes")

    own = kept.where("anchor").select("row", "id", "label", "q")
    first = best(blocks, _blocks(own.repartition(by_anchors), ANCHORS, width, None), same_label=True, k=positives, **common)
    positive = staged(first.select(F.col("anchor_row"), "anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # integer division: the smallest and the largest score inside the window
    lowest = F.expr(f"cast(positive_score * {low} div 100 + case when positive_score * {low} % 100 > 0 then 1 else 0 end as bigint)")
    highest = F.expr(f"cast(positive_score * {high} div 100 - case when positive_score * {high} % 100 < 0 then 1 else 0 end as bigint)")
    windows = positive.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", lowest.alias("low"), highest.alias("high")))).alias("w"))
    windows = windows.select(F.col("anchor_row").alias("row"), F.flatten(F.transform("w", lambda x: F.array(x["low"], x["high"]))).alias("scores"))
    second = best(blocks, _blocks(own.join(windows, "row").repartition(by_anchors), ANCHORS, width, None, windows=True), same_label=False, k=negatives, **common)
    found = second.select("anchor_row", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positive.join(found, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(rows, anchors=F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLE_SQL = {
    "op12_hard_negatives": """
with v as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r ar, a.vec_id anchor_id, a.l al, b.r br, b.vec_id, b.l, list_inner_product(a.q, b.q)::bigint score from v a join v b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select ar, anchor_id, al, br, vec_id positive_id, score positive_score from s where l = al qualify row_number() over (partition by ar order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.ar, p.br order by score desc, vec_id))::int as rank, vec_id negative_id, positive_score, score negative_score
from p join s on p.ar = s.ar and s.l <> s.al and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""
}
