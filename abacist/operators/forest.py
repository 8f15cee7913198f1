"""Trees grown level by level from sums in bins: regression and causal forests, calibration, ranked effects.

A tree never holds rows: they are summed once by (tree, half, bins of all features), and every level of all trees is one
aggregation of these cells by (tree, node, feature, bin).  Where the cells could be too many, a level goes over the rows
themselves, combined on the map side.  Splits come from a window over the sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import clip, uniform
from abacist.operators.causal import _by_fold, _fold_logit, fold_of
from abacist.operators.core import DataInsufficient, Fit, grouped_gram, in_cells, merged, names_of, running, solve_ls, usable
from abacist.operators.panel import written
from abacist.operators.regression import ols

#: Trees times nodes of the deepest level, at most: what a level's splits bring to the driver.
MOST_NODES = 100_000
#: Cells of all trees that rows are summed to, at most; beyond, each level goes over the rows.
MOST_CELLS = 1_000_000


@dataclass
class Forest:
    """Splits by tree and node (root 1, children 2n and 2n + 1): a row goes right where its feature is over the cut.

    ``value`` is each node's weighted sum over its weight, per row of the estimating half: ``num`` and ``den``.
    """

    x: list[str]
    depth: int
    feature: np.ndarray  # trees x nodes, -1 in a leaf
    cut: np.ndarray
    num: np.ndarray
    den: np.ndarray
    seed: int
    share: float
    honest: bool

    def leaves(self, cols: dict[str, Column]) -> Column:
        """Array of the row's leaf in every tree."""
        return _leaves(self.feature, self.cut, self.depth, [cols[c] for c in self.x])

    def predict(self, leaves: Column, key: Column | None = None) -> Column:
        """Sums over trees, divided; with ``key`` only trees that did not draw the row (all, where every tree did)."""
        num, den, names = _table(self.num, float), _table(self.den, float), ("num", "den", "all_num", "all_den")
        pick = lambda table, t: F.element_at(F.element_at(table, t + 1), F.element_at(leaves, t + 1))
        out = lambda t: ~_drawn(self.seed, t, key, self.share) if key is not None else F.lit(True)

        def add(s: Column, t: Column) -> Column:
            n, d, free = pick(num, t), pick(den, t), out(t)
            return F.struct(*[(s[c] + v).alias(c) for c, v in zip(names, (F.when(free, n).otherwise(0.0), F.when(free, d).otherwise(0.0), n, d))])

        ratio = lambda s, of: F.when(s[f"{of}den"] != 0, s[f"{of}num"] / s[f"{of}den"])
        start = F.struct(*[F.lit(0.0).alias(c) for c in names])
        return F.aggregate(_each(self.feature.shape[0]), start, add, lambda s: F.coalesce(ratio(s, ""), ratio(s, "all_")))


def _each(trees: int) -> Column:
    return F.sequence(F.lit(0), F.lit(trees - 1))


def _table(a: np.ndarray, kind: type) -> Column:
    """A small matrix as one constant, so that the size of the code does not grow with it."""
    return F.array(*[F.array(*[F.lit(kind(v)) for v in row]) for row in a])


def _drawn(seed: int, tree, key: Column, share: float) -> Column:
    return F.lit(True) if share >= 1 else uniform(seed, F.lit("drawn"), tree if isinstance(tree, Column) else F.lit(tree), key) < share


def _leaves(feature: np.ndarray, cut: np.ndarray, depth: int, x: list[Column]) -> Column:
    """The node that a row ends in, by tree."""
    values, at, over = F.array(*[c.cast("double") for c in x]), _table(feature, int), _table(cut, float)
    return F.transform(_each(len(feature)), lambda t: _walk(F.element_at(at, t + 1), F.element_at(over, t + 1), depth, values))


def _walk(f: Column, c: Column, depth: int, values: Column) -> Column:
    """The node of ``values`` in a tree of features and cuts: from the root, one level a step of a fold."""
    step = lambda node, _: F.when(F.element_at(f, node) < 0, node).otherwise(2 * node + (F.element_at(values, F.element_at(f, node) + 1) > F.element_at(c, node)).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def edges(df: DataFrame, x: list[str], bins: int = 32) -> list[list[float]]:
    """Cuts between bins: approximate quantiles of each feature from one aggregation, repeated ones once."""
    row = df.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 50 * bins) for c in x]).first()
    return [sorted({float(v) for v in r or []}) for r in row]


def grow(df: DataFrame, num: str, den: str, x: list[str], *, trees: int = 1, depth: int = 3, least: int = 20, bins: int = 32, key: str | None = None, share: float = 1.0, honest: bool = False, features: int | None = None, seed: int = 0, cuts: list[list[float]] | None = None) -> Forest:
    """Trees whose splits raise sum(num)^2 / sum(den) the most: ``den`` of 1 and ``num`` of y are a regression tree,
    products of residuals and squared residuals of the treatment a causal one.

    A side needs ``least`` rows and a positive ``den``.  Ties go to the first feature and the lowest cut.  With ``share``
    each tree draws rows by a hash of ``key``; ``honest`` splits these in halves, one to find the splits, the other for
    the values.  ``features``: how many, drawn by hash, a node may split on.  Rows with a null or NaN drop.
    """
    if (share < 1 or honest) and key is None:
        raise ValueError("drawing rows needs a key")
    if trees * 2**depth > MOST_NODES:
        raise ValueError(f"over {MOST_NODES} nodes")
    d = usable(df, {"__num": F.col(num), "__den": F.col(den), **{f"__x{i}": F.col(c) for i, c in enumerate(x)}}, (key,) if key else ())
    cuts = cuts or edges(d, [f"__x{i}" for i in range(len(x))], bins)
    size = 2 ** (depth + 1) - 1
    feature, cut = np.full((trees, size), -1), np.zeros((trees, size))
    place = np.zeros((trees, size))  # the cuts by their number
    B = [f"__b{i}" for i in range(len(x))]
    spot = [sum(((F.col(f"__x{i}") > F.lit(c)).cast("int") for c in cs), F.lit(0)).alias(b) for i, (b, cs) in enumerate(zip(B, cuts))]
    who = F.col(key) if key else F.lit(0)
    half = lambda t: F.when(uniform(seed, F.lit("half"), t, who) < 0.5, 0).otherwise(1) if honest else F.lit(0)
    drawn = F.transform(_each(trees), lambda t: F.when(_drawn(seed, t, who, share), half(t)))
    cells = d.select("__num", "__den", *spot, F.posexplode(drawn).alias("__t", "__half")).where("__half is not null")
    if 2 * trees * math.prod(len(c) + 1 for c in cuts) <= MOST_CELLS:
        cells = written(cells.groupBy("__t", "__half", *B).agg(F.count("*").alias("__m"), F.sum("__num").alias("__num"), F.sum("__den").alias("__den")), df.sparkSession)
    else:
        cells = cells.withColumn("__m", F.lit(1))
    cells = cells.withColumn("__bins", F.array(*B))

    def placed(part: int) -> DataFrame:
        f, c = (F.element_at(_table(v, int), F.col("__t") + 1) for v in (feature, place))
        return cells.where(f"__half = {part}").withColumn("__n", _walk(f, c, depth, F.col("__bins")))

    live: set[tuple[int, int]] = {(t, 1) for t in range(trees)}
    for level in range(depth):
        if not live:
            break
        long = placed(0).where(f"__n >= {2**level}").select("__m", "__num", "__den", "__t", "__n", F.posexplode("__bins").alias("__f", "__b"))
        if features and features < len(x):
            rank = lambda f: uniform(seed, F.lit("features"), F.col("__t"), F.col("__n"), f)
            ahead = sum(((rank(F.lit(j)) < rank(F.col("__f"))).cast("int") for j in range(len(x))), F.lit(0))
        sums = long.groupBy("__t", "__n", "__f", "__b").agg(F.sum("__m").alias("m"), F.sum("__num").alias("a"), F.sum("__den").alias("b"))
        group = Window.partitionBy("__t", "__n", "__f")
        upto = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        both = sums.select("__t", "__n", "__f", "__b", *[F.sum(c).over(w).alias(f"{p}{c}") for p, w in (("l", upto), ("t", group)) for c in ("m", "a", "b")])
        both = both.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in ("m", "a", "b")})
        ok = both.where(f"lm >= {least} and rm >= {least} and lb > 0 and rb > 0")
        if features and features < len(x):
            ok = ok.where(ahead < features)
        ok = ok.withColumn("gain", F.expr("la * la / lb + ra * ra / rb - ta * ta / tb")).where("gain > 1e-12 * (la * la / lb + ra * ra / rb)")
        first = ok.groupBy("__t", "__n").agg(F.max(F.struct("gain", -F.col("__f"), -F.col("__b"))).alias("s"))
        grown = set()
        for t, n, s in first.collect():  # a row per node, bounded above
            f, b = -s[1], -s[2]
            feature[t, n - 1], cut[t, n - 1], place[t, n - 1] = f, cuts[f][b], b
            grown |= {(t, 2 * n), (t, 2 * n + 1)}
        live = grown
    num_, den_ = np.zeros((trees, size)), np.zeros((trees, size))
    for t, n, a, b, m in placed(int(honest)).groupBy("__t", "__n").agg(F.sum("__num"), F.sum("__den"), F.sum("__m")).collect():
        num_[t, n - 1], den_[t, n - 1] = a / m, b / m
    return Forest(x, depth, feature, cut, num_, den_, seed, share, honest)


# ---------------------------------------------------------------- causal forests
def residuals(df: DataFrame, y: str, treat: str, x: list[str], key: str, folds: int = 5, seed: int = 0, trim: float = 0.01) -> DataFrame:
    """Usable rows with ``__m``, ``__e`` (mean outcome and chance of treatment from other folds) and ``__score``,
    the doubly robust effect of each row; outcome models by arm, treatment by logit.  They are written once."""
    d = usable(df, names_of([y, treat, *x]), (key,)).withColumn("__f", fold_of(folds, seed, F.col(key)))
    g = grouped_gram(d, [y, *x], ["__f", treat])
    rest = lambda f, v: merged([p for (h, t), p in g.items() if h != f and t == v])
    arm = {v: _by_fold({f: solve_ls(rest(f, v), 0, list(range(1, len(x) + 1)))[0] for f in range(folds)}, x) for v in (0, 1)}
    e = clip(1 / (1 + F.exp(-_by_fold(_fold_logit(d, treat, x, folds), x))), trim, 1 - trim)
    d = d.withColumns({"__m1": arm[1], "__m0": arm[0], "__e": e})
    d = d.withColumn("__m", F.expr("__e * __m1 + (1 - __e) * __m0"))
    t, v = F.col(treat), F.col(y)
    score = F.col("__m1") - F.col("__m0") + t * (v - F.col("__m1")) / F.col("__e") - (1 - t) * (v - F.col("__m0")) / (1 - F.col("__e"))
    return written(d.withColumn("__score", score).drop("__f", "__m1", "__m0"), df.sparkSession)


def causal_forest(df: DataFrame, y: str, treat: str, x: list[str], key: str, *, trees: int = 20, depth: int = 4, least: int = 20, bins: int = 32, share: float = 0.5, features: int | None = None, folds: int = 5, seed: int = 0) -> tuple[DataFrame, Forest]:
    """(rows of ``residuals`` with ``effect``, from trees that did not draw the row; the forest), honest halves."""
    d = residuals(df, y, treat, x, key, folds, seed)
    u, v = F.col(y) - F.col("__m"), F.col(treat) - F.col("__e")
    d = d.withColumns({"__uv": u * v, "__vv": v * v})
    forest = grow(d, "__uv", "__vv", x, trees=trees, depth=depth, least=least, bins=bins, key=key, share=share, honest=True, features=features, seed=seed)
    d = d.drop("__uv", "__vv").withColumn("__leaf", forest.leaves({c: F.col(c) for c in x}))
    # what is told of the effects reads them several times
    return written(d.withColumn("effect", forest.predict(F.col("__leaf"), F.col(key))).drop("__leaf"), df.sparkSession), forest


def calibration(df: DataFrame, y: str, treat: str, effect: str = "effect") -> Fit:
    """Residual outcome on the mean effect and the effect's departure from it, each times the residual treatment, no constant.

    A slope of 1 on ``mean`` says the average is right, one over 0 on ``departure`` that the effects do differ (HC3).
    """
    mean = df.agg(F.avg(effect)).first()[0]
    if mean is None:
        raise DataInsufficient("no usable rows")
    v = F.col(treat) - F.col("__e")
    d = df.select((F.col(y) - F.col("__m")).alias("u"), (v * mean).alias("mean"), (v * (F.col(effect) - mean)).alias("departure"))
    return ols(d, "u", ["mean", "departure"], vcov="HC3", intercept=False)


def ranked_effect(df: DataFrame, score: str, priority: str, target: str = "AUTOC", alpha: float = 0.05) -> dict[str, float]:
    """Rank-weighted average effect: the mean of ``score`` among rows of the highest priority, less that of all, over all shares.

    ``AUTOC`` weighs shares alike, ``QINI`` by the share.  Rows with the same priority count at the mean of their places.
    Priorities are aggregated to distinct values first; running sums go over cells of these, so no task sorts the table.
    """
    if target not in ("AUTOC", "QINI"):
        raise ValueError("the target is AUTOC or QINI")
    per = usable(df, {"p": F.col(priority), "s": F.col(score)}).groupBy("p").agg(F.count("*").cast("double").alias("m"), F.sum("s").alias("a"), F.sum(F.col("s") ** 2).alias("q"))
    cells = in_cells(per, "p")
    r = running(cells, "p", {"m": F.col("m"), "a": F.col("a")}, down=True)
    n_all = per.agg(F.sum("m"), F.sum("a")).first()
    if not n_all[0] or n_all[0] < 2:
        raise DataInsufficient("fewer than two usable rows")
    n, mean = n_all[0], n_all[1] / n_all[0]
    # a row at place r of n adds to every share q >= r/n: weights are sums of 1/place, or of 1/n
    before = F.col("run_m") - F.col("m")
    if target == "QINI":
        # sum over places k = b + 1 .. b + m of (n - k + 1) / n, over m
        weight = (n - before - (F.col("m") - 1) / 2) / n - (n + 1) / (2 * n)
    else:
        # the mean of H(n) - H(k - 1) over k = b + 1 .. b + m, by sum of H(k - 1) = (b + m) H(b + m) - b H(b) - m
        tail = (F.col("run_m") * _harmonic(F.col("run_m")) - before * _harmonic(before) - F.col("m")) / F.col("m")
        weight = _harmonic(F.lit(n)) - tail - 1
    w = r.select("m", "a", "q", weight.alias("w"))
    est = w.agg(F.sum(F.col("w") * F.col("a"))).first()[0] / n
    # influence of a row: its weight times its distance from the mean score
    ss = w.agg(F.sum(F.col("w") ** 2 * (F.col("q") - 2 * mean * F.col("a") + mean**2 * F.col("m"))), F.sum(F.col("w") * (F.col("a") - mean * F.col("m")))).first()
    se = math.sqrt(max(ss[0] / n - (ss[1] / n) ** 2, 0.0) / (n - 1))
    z = dist.norm_ppf(1 - alpha / 2)
    return {"estimate": est, "std_error": se, "ci_low": est - z * se, "ci_high": est + z * se, "n": n}


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n as an expression: the sum itself below 20, its asymptotic series (error below 1e-12) from there."""
    table = F.array(*[F.lit(float(sum(1 / k for k in range(1, i + 1)))) for i in range(20)])
    series = F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n**4) - 1 / (252 * n**6)
    return F.when(n < 20, F.element_at(table, F.least(n, F.lit(19.0)).cast("int") + 1)).otherwise(series)
