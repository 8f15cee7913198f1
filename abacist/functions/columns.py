"""Row-wise functions as Column expressions: egen-style row statistics, bins, hash uniforms, kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c) -> Column:
    """A column as double, with NaN as null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def _present(cols) -> Column:
    return F.filter(F.array(*[num(c) for c in cols]), lambda x: x.isNotNull())


def row_count(*cols) -> Column:
    """Number of values that are present."""
    return F.size(_present(cols))


def row_total(*cols) -> Column:
    """Sum over the values present; 0 without any."""
    return F.aggregate(_present(cols), F.lit(0.0), lambda a, x: a + x)


def row_mean(*cols) -> Column:
    return F.when(row_count(*cols) > 0, row_total(*cols) / row_count(*cols))


def row_max(*cols) -> Column:
    return F.array_max(_present(cols))


def row_min(*cols) -> Column:
    return F.array_min(_present(cols))


def row_sd(*cols) -> Column:
    """Sample standard deviation over the values present; null with fewer than two."""
    n, m = row_count(*cols), row_mean(*cols)
    ss = F.aggregate(F.transform(_present(cols), lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def uniform(seed: int, *keys) -> Column:
    """Uniform on (0, 1) from a hash of keys: the same for any partitioning."""
    h = F.xxhash64(F.lit(seed), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, *keys) -> Column:
    """Standard normal from two hash uniforms (Box-Muller)."""
    u, v = uniform(seed, F.lit(1), *keys), uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def poisson1(seed: int, *keys) -> Column:
    """Poisson(1) bootstrap weight from a hash uniform; beyond 8 the chance is under 2e-6."""
    u, total, out = uniform(seed, *keys), 0.0, F.lit(8)
    cuts = []
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        cuts.append((total, k))
    for cut, k in reversed(cuts):
        out = F.when(u < cut, F.lit(k)).otherwise(out)
    return out


def kernel(u: Column, name: str = "triangular") -> Column:
    """Kernel weight at scaled distance u, zero beyond 1."""
    a = F.abs(u)
    body = {"triangular": 1 - a, "epanechnikov": 0.75 * (1 - u * u), "uniform": F.lit(0.5)}[name]
    return F.when(a <= 1, body).otherwise(F.lit(0.0))


def clip(c, lo: float, hi: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))
