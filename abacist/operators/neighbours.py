"""Nearest-neighbour joins in several dimensions, and what is built on them: spatial weights and matching.

Points lie in a grid whose cuts are quantiles along the principal axes of the data, at most three of
them, so that cells hold about as many points each.  A query looks at a block of cells around its own.
It is done once its k-th distance is shorter than the way out of the block; otherwise the block grows to
hold that distance, or to twice its reach if fewer than k points were met.  No query meets all points
unless its block has to hold them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from abacist.operators.core import DataInsufficient, Fit, gram
from abacist.operators.panel import written

#: Dimensions of the grid and cuts of one dimension, at most; points of a cell, about.
AXES, CUTS, IN_CELL = 3, 200, 64
#: Distances that a task holds at a time.
ENTRIES = 1 << 20


def metric(points: DataFrame, cols: list[str], kind: str = "euclidean", weights: list[float] | None = None) -> np.ndarray:
    """Matrix M so that the distance of x and y is |M (x - y)|: euclidean, scaled (by standard deviations) or mahalanobis; ``weights`` scale its rows' squares."""
    if kind == "euclidean":
        m = np.eye(len(cols))
    else:
        g = gram(points.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna(), cols)
        cov = g.cross / max(g.n - 1, 1)
        if (np.diag(cov) <= 0).any() or kind == "mahalanobis" and np.linalg.cond(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))) > 1e12:
            raise DataInsufficient("a column is constant, or columns are collinear")
        m = np.diag(1 / np.sqrt(np.diag(cov))) if kind == "scaled" else np.linalg.cholesky(np.linalg.inv(cov)).T
    return m if weights is None else np.diag(np.sqrt(weights)) @ m


def _times(m: np.ndarray, cols: list[str], name: str) -> list[Column]:
    return [sum((F.lit(float(v)) * F.col(c) for v, c in zip(row, cols) if v), F.lit(0.0)).alias(f"{name}{i}") for i, row in enumerate(m)]


def _cell(df: DataFrame, cuts: list[list[float]], values: list[str], into: list[str]) -> DataFrame:
    from pyspark.ml.feature import Bucketizer

    return Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=values, outputCols=into).transform(df)


def _smallest(square: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest values of each row in rising order, ties by column."""
    if square.shape[1] <= k:
        return np.argsort(square, axis=1, kind="stable")
    some = np.sort(np.argpartition(square, k - 1, axis=1)[:, :k], axis=1)
    value = np.take_along_axis(square, some, 1)
    some = np.take_along_axis(some, np.argsort(value, axis=1, kind="stable"), 1)
    tied = (square <= value.max(1)[:, None]).sum(1) > k
    if tied.any():
        some[tied] = np.argsort(square[tied], axis=1, kind="stable")[:, :k]
    return some


class _Block:
    """The nearest points of one cell's places, while points arrive in the order of their ids."""

    def __init__(self, k: int, d: int, rows: pa.Schema):
        self.k, self.d, self.asked, self.at = k, d, [], None
        self.held = pa.RecordBatch.from_pylist([], rows)

    def meet(self, points: pa.RecordBatch) -> None:
        """``points``: coordinates first, then what is kept of a point."""
        if self.at is None:
            self.at = np.concatenate([np.column_stack([b.column(i).to_numpy() for i in range(self.d)]) for b in self.asked])
            self.square, self.index = np.full((len(self.at), 0), 0.0), np.full((len(self.at), 0), 0)
        p = np.column_stack([points.column(i).to_numpy() for i in range(self.d)])
        first = self.held.num_rows
        kept = points.select(range(self.d, points.num_columns))
        self.held = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(self.held.columns, kept.columns)], schema=self.held.schema)
        step, squares, indices = max(1, ENTRIES // len(p)), [], []
        for s in range(0, len(self.at), step):
            own = slice(s, s + step)
            found = sum(((self.at[own, i, None] - p[None, :, i]) ** 2 for i in range(self.d)), 0.0)
            found = np.hstack([self.square[own], found])
            best = _smallest(found, self.k)
            index = np.hstack([self.index[own], np.broadcast_to(np.arange(first, first + len(p)), (len(found), len(p)))])
            squares.append(np.take_along_axis(found, best, 1))
            indices.append(np.take_along_axis(index, best, 1))
        self.square, self.index = np.vstack(squares), np.vstack(indices)
        if self.held.num_rows > self.index.size:
            used, place = np.unique(self.index, return_inverse=True)
            self.held, self.index = self.held.take(pa.array(used)), place.reshape(self.index.shape)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in self.asked:
            n, m = b.num_rows, 0 if self.at is None else self.index.shape[1]
            index, square = (self.index[at : at + n], self.square[at : at + n]) if m else (np.zeros((n, 0), int), np.zeros((n, 0)))
            kept = self.held.take(pa.array(index.ravel(), pa.int64()))
            kind = schema.field("near").type
            item = pa.StructArray.from_arrays([pa.array(square.ravel(), pa.float64()), *[c.cast(kind.value_type.field(i + 1).type) for i, c in enumerate(kept.columns)]], fields=[kind.value_type.field(i) for i in range(kind.value_type.num_fields)])
            near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), item, type=kind)
            far = pa.array(square[:, -1], pa.float64()) if m else pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, m), pa.int32()), far, near], schema=schema)
            at += n


def placed(queries: DataFrame, points: DataFrame, k: int, cols: list[str], *, query_id: str, point_id: str | None = None, m: np.ndarray | None = None, more: list[str] = []) -> DataFrame:
    """(__z0, __z1 ..., near) of each distinct place of the queries, M x: the ``k`` nearest points as (square, point, columns ``more``), ties by smaller id.

    Of the points at one place only the ``k`` smallest ids take part, as no other can be among the nearest, and a place is
    searched once however many queries lie there.  A cell's places meet the points of the blocks they look at in one task,
    which reads them batch by batch and keeps ``k`` for each place, so that no pairs are shuffled or sorted.
    """
    spark, point_id = points.sparkSession, point_id or query_id
    m = np.eye(len(cols)) if m is None else m
    d, Z = len(m), [f"__z{i}" for i in range(len(m))]
    kept = ["point", *[f"v{i}" for i in range(len(more))]]
    p = points.select(F.col(point_id).alias("point"), *[F.col(c).alias(v) for c, v in zip(more, kept[1:])], *[F.col(c).cast("double").alias(f"__{c}") for c in cols]).dropna(subset=["point", *[f"__{c}" for c in cols]])
    p = p.select(*kept, *_times(m, [f"__{c}" for c in cols], "__z"))
    p = written(p.withColumn("__r", F.row_number().over(Window.partitionBy(*Z).orderBy("point"))).where(F.col("__r") <= k).drop("__r"), spark)
    places = _plain(queries, query_id, cols, m).select(*Z).distinct()
    item = T.StructType([T.StructField("square", T.DoubleType()), *[T.StructField(c, p.schema[v].dataType) for c, v in zip(["point", *more], kept)]])
    result = T.StructType([*[T.StructField(z, T.DoubleType()) for z in Z], T.StructField("near", T.ArrayType(item))])
    try:
        g = gram(p, Z)
    except DataInsufficient:
        return spark.createDataFrame([], result)
    axes = np.linalg.eigh(g.cross)[1].T[::-1][: min(d, AXES)]
    A, turn = [f"a{i}" for i in range(len(axes))], lambda df: df.select("*", *_times(axes, Z, "a"))
    n = min(CUTS, max(1, round((g.rows / max(IN_CELL, 4 * k)) ** (1 / len(axes)))))
    p = turn(p)
    found = p.agg(*[F.percentile_approx(a, [i / n for i in range(1, n)] or [0.5], 100 * n) for a in A]).first()
    cuts = [sorted({float(x) for x in c}) for c in found]
    C, LO, HI = ([f"{x}{i}" for i in range(len(axes))] for x in ("c", "lo", "hi"))
    cell = sum((F.col(c).cast("long") * (CUTS + 1) ** i for i, c in enumerate(C)), F.lit(0).cast("long"))
    p = written(_cell(p, cuts, A, C).select(*Z, *kept, cell.alias("cell")), spark)
    most = [len(c) for c in cuts]
    edge = [F.array(*[F.lit(x) for x in [-math.inf, *c, math.inf]]) for c in cuts]
    inside = lambda c, i: F.least(F.greatest(c, F.lit(0)), F.lit(most[i]))
    open_ = _cell(turn(places), cuts, A, C)
    around = [inside(F.col(c).cast("int") + s, i).alias(x[i]) for s, x in ((-1, LO), (1, HI)) for i, c in enumerate(C)]
    open_ = written(open_.select(*Z, cell.alias("home"), *around), spark)
    state, asked = [*Z, "home", *LO, *HI], ["home", "__kind", *Z, *LO, *HI, *kept]
    schema = T.StructType([*[open_.schema[c] for c in state], T.StructField("met", T.IntegerType()), T.StructField("far", T.DoubleType()), result["near"]])
    arrow = to_arrow_schema(schema)
    points_at = [asked.index(c) for c in [*Z, *kept]]
    state_at = [asked.index(c) for c in state]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, block = None, None
        for b in batches:
            at = b.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for s, e in zip(ends, ends[1:]):
                if e == s:
                    continue
                if block is None or at[s] != home:
                    if block is not None:
                        yield from block.rows(arrow)
                    home, block = at[s], _Block(k, d, pa.schema([b.schema.field(asked.index(c)) for c in kept]))
                part = b.slice(s, e - s)
                own = int(np.searchsorted(part.column(1).to_numpy(), 1))
                if own:
                    block.asked.append(part.slice(0, own).select(state_at))
                if own < e - s:
                    block.meet(part.slice(own).select(points_at))
        if block is not None:
            yield from block.rows(arrow)

    done = None
    while True:
        block = open_.select("home", *LO, *HI).distinct()
        for i, c in enumerate(C):
            block = block.withColumn(c, F.explode(F.sequence(LO[i], HI[i])))
        looked = block.select("home", cell.alias("cell")).distinct()
        void = lambda c: F.lit(None).cast("int").alias(c)
        those = looked.join(p, "cell").select("home", F.lit(1).alias("__kind"), *Z, *[void(c) for c in LO + HI], *kept)
        these = open_.select("home", F.lit(0).alias("__kind"), *Z, *LO, *HI, *[F.lit(None).cast(p.schema[c].dataType).alias(c) for c in kept])
        both = these.unionByName(those).repartition("home").sortWithinPartitions("home", "__kind", "point")
        got = written(both.select(*asked).mapInArrow(search, schema), spark)
        # a little more than the distance itself: axes and columns round differently
        after = turn(got.drop("near")).withColumn("__r", F.sqrt("far") * (1 + 1e-9) + 1e-300)
        way, whole = F.lit(math.inf), F.lit(True)
        for i, a in enumerate(A):
            way = F.least(way, F.col(a) - F.get(edge[i], F.col(LO[i])), F.get(edge[i], F.col(HI[i]) + 1) - F.col(a))
            whole = whole & (F.col(LO[i]) == 0) & (F.col(HI[i]) == most[i])
        enough = F.col("met") == k
        closed = whole | enough & (F.col("__r") <= way)
        left = after.where(~closed).withColumns({f"{x}{a}": F.when(enough, F.col(a) + s * F.col("__r")).otherwise(0.0) for a in A for x, s in (("u", -1), ("v", 1))})
        filled = _cell(left, cuts + cuts, [f"u{a}" for a in A] + [f"v{a}" for a in A], [f"n{x}" for x in LO + HI])
        wider = {}
        for i in range(len(A)):
            step = F.col(HI[i]) - F.col(LO[i])
            wider[LO[i]] = F.least(F.col(LO[i]), F.when(enough, F.col(f"n{LO[i]}").cast("int")).otherwise(inside(F.col(LO[i]) - step, i)))
            wider[HI[i]] = F.greatest(F.col(HI[i]), F.when(enough, F.col(f"n{HI[i]}").cast("int")).otherwise(inside(F.col(HI[i]) + step, i)))
        open_ = filled.select(*Z, "home", *[wider[x].alias(x) for x in LO + HI])
        some = turn(got).withColumn("__r", F.sqrt("far") * (1 + 1e-9) + 1e-300).where(closed).select(*Z, "near")
        done = some if done is None else done.unionByName(some)
        if open_.isEmpty():
            return done.select(*Z, F.col("near").cast(result["near"].dataType).alias("near"))


def _plain(df: DataFrame, i: str, cols: list[str], m: np.ndarray) -> DataFrame:
    return df.select(F.col(i).alias("query"), *[F.col(c).cast("double").alias(f"__{c}") for c in cols]).dropna().select("query", *_times(m, [f"__{c}" for c in cols], "__z"))


def _lists(queries: DataFrame, points: DataFrame, k: int, cols: list[str], *, query_id: str, point_id: str | None = None, m: np.ndarray | None = None, apart: bool = False) -> DataFrame:
    """(query, near): the ``k`` nearest points of each query as an array of (square, point)."""
    m = np.eye(len(cols)) if m is None else m
    at = placed(queries, points, k + apart, cols, query_id=query_id, point_id=point_id, m=m)
    Z = [f"__z{i}" for i in range(len(m))]
    near = F.filter("near", lambda v: v["point"] != F.col("query")) if apart else F.col("near")
    return _plain(queries, query_id, cols, m).join(at, Z).select("query", F.slice(near, 1, k).alias("near"))


def nearest(queries: DataFrame, points: DataFrame, k: int, cols: list[str], *, query_id: str, point_id: str | None = None, m: np.ndarray | None = None, apart: bool = False) -> DataFrame:
    """The ``k`` nearest points of each query: (query, rank, point, distance); ties by smaller point id.

    Rows with a null in the columns or the id take no part.  With ``apart`` a point does not count as its own
    neighbour.  A query meets fewer than ``k`` points only where there are no more.  Ids must not repeat.
    """
    each = _lists(queries, points, k, cols, query_id=query_id, point_id=point_id, m=m, apart=apart).select("query", F.posexplode("near").alias("rank", "v"))
    return each.select("query", (F.col("rank") + 1).alias("rank"), F.col("v.point").alias("point"), F.sqrt("v.square").alias("distance"))


# ---------------------------------------------------------------- spatial weights
KERNELS = {
    "uniform": lambda u: F.lit(0.5),
    "triangular": lambda u: 1 - u,
    "epanechnikov": lambda u: 0.75 * (1 - u * u),
    "quartic": lambda u: 15 / 16 * (1 - u * u) ** 2,
    "gaussian": lambda u: F.exp(-u * u / 2) / math.sqrt(2 * math.pi),
}


def knn_weights(points: DataFrame, cols: list[str], k: int, *, id_col: str, standardise: bool = True) -> DataFrame:
    """(i, j, w): 1 for each of the ``k`` nearest others, or 1 over their number."""
    near = _lists(points, points, k, cols, query_id=id_col, apart=True)
    w = 1 / F.size("near") if standardise else F.lit(1.0)
    return near.select(F.col("query").alias("i"), w.alias("w"), F.explode("near.point").alias("j")).select("i", "j", "w")


def kernel_weights(points: DataFrame, cols: list[str], k: int, *, id_col: str, kernel: str = "triangular", bandwidth: float | None = None) -> DataFrame:
    """(i, j, w): kernel of the distance over the bandwidth, which is given or each point's distance to its ``k``-th neighbour; i = j counts.

    With a given bandwidth, only neighbours up to it among the ``k`` nearest count.
    """
    near = _lists(points, points, k, cols, query_id=id_col, apart=True).where(F.size("near") > 0)
    h = F.lit(float(bandwidth)) if bandwidth else F.sqrt(F.element_at("near", -1)["square"])
    # a point stands first in its own list
    own = F.struct(F.lit(0.0).alias("square"), F.col("query").alias("point"))
    met = near.select("query", h.alias("h"), F.posexplode(F.concat(F.array(own), F.transform("near", lambda v: F.struct(v["square"].alias("square"), v["point"].alias("point"))))).alias("rank", "v"))
    u = F.when((F.col("rank") > 0) & (F.col("h") > 0), F.sqrt("v.square") / F.col("h")).otherwise(F.lit(0.0))
    return met.withColumn("u", u).where("u <= 1").select(F.col("query").alias("i"), F.col("v.point").alias("j"), KERNELS[kernel](F.col("u")).cast("double").alias("w"))


def spatial_lag(values: DataFrame, weights: DataFrame, col: str, id_col: str) -> DataFrame:
    """(i, value, lag): each unit's value and the weighted sum of its neighbours'."""
    v = values.select(F.col(id_col).alias("__id"), F.col(col).cast("double").alias("__v"))
    lag = weights.join(v, F.col("j") == F.col("__id")).groupBy("i").agg(F.sum(F.col("w") * F.col("__v")).alias("lag"))
    return v.join(lag, F.col("__id") == F.col("i")).select("i", F.col("__v").alias("value"), "lag")


# ---------------------------------------------------------------- matching
def match(df: DataFrame, y: str, treat: str, x: list[str], *, id_col: str, k: int = 1, kind: str = "mahalanobis", weights: list[float] | None = None, caliper: float | None = None, adjust: bool = False) -> tuple[Fit, DataFrame]:
    """(average effect on the treated, matched pairs) by the ``k`` nearest controls, with replacement.

    ``caliper``: pairs farther apart do not count; a treated row without any goes.  ``adjust`` takes out what differences
    in ``x`` predict, by a regression over the matched controls.  The error is that of matching estimators with
    replacement, conditional on ``x``: outcome variances from each row's nearest row of its own arm.
    """
    own = df.select(F.col(id_col).alias("__id"), F.col(treat).cast("int").alias("__t"), *[F.col(c).cast("double").alias(c) for c in [y, *x]]).dropna()
    own = written(own, df.sparkSession)
    m = metric(own, x, kind, weights)
    arm = {t: own.where(F.col("__t") == t) for t in (0, 1)}
    near = nearest(arm[1], arm[0], k, x, query_id="__id", m=m)
    if caliper is not None:
        near = near.where(F.col("distance") <= caliper)
    near = written(near, df.sparkSession)
    shift = F.lit(0.0)
    left, right = (own.select(F.col("__id").alias(f"__i{s}"), *[F.col(c).alias(f"{c}__{s}") for c in [y, *x]]) for s in "tc")
    pairs = near.join(left, F.col("query") == F.col("__it")).join(right, F.col("point") == F.col("__ic"))
    pairs = pairs.withColumn("__w", 1 / F.count("*").over(Window.partitionBy("query")))
    if adjust:
        from abacist.operators.regression import ols

        used = pairs.groupBy("point").agg(F.sum("__w").alias("__k")).join(own, F.col("point") == F.col("__id"))
        fit = ols(used, y, x, weights="__k")
        shift = sum((F.lit(fit[c]) * (F.col(f"{c}__t") - F.col(f"{c}__c")) for c in x), F.lit(0.0))
    pairs = written(pairs.withColumn("__e", F.col(f"{y}__t") - F.col(f"{y}__c") - shift), df.sparkSession)
    each = pairs.groupBy("query").agg(F.sum(F.col("__w") * F.col("__e")).alias("e"))
    n, effect = each.agg(F.count("*"), F.avg("e")).first()
    if not n:
        raise DataInsufficient("no treated row has a match")
    spread = each.agg(F.sum((F.col("e") - effect) ** 2)).first()[0]
    # variance of outcomes at about equal x: half the squared difference to the nearest row of the same arm
    twin = nearest(arm[0], arm[0], 1, x, query_id="__id", m=m, apart=True).join(right.drop(*[f"{c}__c" for c in x]), F.col("point") == F.col("__ic"))
    noise = twin.join(own.select("__id", F.col(y).alias("__y")), F.col("query") == F.col("__id")).select(F.col("query").alias("__q"), ((F.col("__y") - F.col(f"{y}__c")) ** 2 / 2).alias("__s2"))
    used = pairs.groupBy("point").agg(F.sum("__w").alias("__k"), F.sum(F.col("__w") ** 2).alias("__k2")).join(noise, F.col("point") == F.col("__q"), "left")
    extra = used.agg(F.sum(F.coalesce("__s2", F.lit(0.0)) * (F.col("__k") ** 2 - F.col("__k2")))).first()[0]
    var = (spread + (extra or 0.0)) / n**2
    out = pairs.select("query", "point", "rank", "distance", F.col("__w").alias("weight"), F.col("__e").alias("effect"))
    return Fit(["att"], np.array([effect]), np.array([[var]]), n, math.inf, {"controls": used.count()}), out
