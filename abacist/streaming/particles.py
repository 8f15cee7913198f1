"""Particle filter per key: a batch form and a stateful stream that give the same rows."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.operators.core import spread

#: Rows of a task: a row costs far more time than its bytes suggest, so tasks are cut by rows.
ROWS = 20_000
#: Particles that move together, of one key or several.
TOGETHER = 32_000
#: Below so many keys each moves by itself.
FEW = 4


class Filter:
    """Settings and one step; draws depend on seed, key and the row's number within its key only."""

    def __init__(self, particles: int = 1000, prior_mean: float = 0.0, prior_var: float = 1.0, process_sd: float = 0.0, threshold: float = 0.5, alpha: float = 0.05, seed: int = 0, transition: Callable | None = None, log_density: Callable | None = None):
        if particles < 100 or not 0 < threshold <= 1:
            raise ValueError("at least 100 particles, and a threshold over 0 up to 1")
        self.n, self.mean, self.sd, self.process_sd = particles, prior_mean, math.sqrt(prior_var), process_sd
        self.threshold, self.alpha, self.seed = threshold, alpha, seed
        self.transition, self.log_density = transition, log_density

    def start(self, key) -> tuple[np.ndarray, np.ndarray, int]:
        return self.rng(key, 0).normal(self.mean, self.sd, self.n), np.zeros(self.n), 0

    def rng(self, key, row: int) -> np.random.Generator:
        words = [self.seed, zlib.crc32(b"\0" if key is None else str(key).encode()), row]
        # the same seed as a list gives, in less time
        return np.random.default_rng(np.random.SeedSequence(np.array(words, dtype=np.uint32)) if 0 <= self.seed < 2**32 else words)

    def step(self, key, state: tuple, estimate: float, se: float) -> tuple[tuple, tuple]:
        """(next state, (mean, variance, low, high, effective size)).

        A missing estimate, or an error that is missing or not above 0, moves the particles and tells nothing about them.
        """
        x, w, row = state
        rng = self.rng(key, row + 1)
        if self.transition:
            x = np.asarray(self.transition(x, rng), dtype=float)
        elif self.process_sd > 0:
            x = x + rng.normal(0.0, self.process_sd, self.n)
        if estimate is not None and se is not None and math.isfinite(estimate) and se > 0:
            w = w + (self.log_density(estimate, x, se) if self.log_density else -0.5 * ((estimate - x) / se) ** 2)
        w = w - w.max()
        p = np.exp(w)
        p /= p.sum()
        mean = float(p @ x)
        variance, size = float(p @ (x - mean) ** 2), float(1 / (p @ p))
        order = np.argsort(x, kind="stable")
        reach = np.cumsum(p[order])
        low, high = (float(x[order][min(np.searchsorted(reach, q), self.n - 1)]) for q in (self.alpha / 2, 1 - self.alpha / 2))
        if size < self.threshold * self.n:
            # systematic draws: one uniform, equal steps along the weights
            picks = np.searchsorted(np.cumsum(p), (rng.random() + np.arange(self.n)) / self.n)
            x, w = x[np.minimum(picks, self.n - 1)], np.zeros(self.n)
        return (x, w, row + 1), (mean, variance, low, high, size)

    def steps(self, keys: list, rows: list[int], x: np.ndarray, w: np.ndarray, estimate: np.ndarray, se: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``step`` of several keys at once, to the last bit: (x, w, results), a row for each key; ``rows`` are the rows before."""
        n, every = self.n, np.arange(len(keys))
        rngs = [self.rng(k, r + 1) for k, r in zip(keys, rows)]
        if self.transition:
            x = np.stack([np.asarray(self.transition(v, g), dtype=float) for v, g in zip(x, rngs)])
        elif self.process_sd > 0:
            x = x + np.stack([g.normal(0.0, self.process_sd, n) for g in rngs])
        told = np.isfinite(estimate) & (se > 0)
        if self.log_density:
            w = np.stack([v + self.log_density(float(e), u, float(s)) if t else v for t, u, v, e, s in zip(told, x, w, estimate, se)])
        else:
            news = -0.5 * ((estimate[:, None] - x) / np.where(told, se, 1.0)[:, None]) ** 2
            w = w + (news if told.all() else np.where(told[:, None], news, 0.0))
        w = w - w.max(axis=1, keepdims=True)
        p = np.exp(w)
        p /= p.sum(axis=1, keepdims=True)
        dot = lambda a, b: (a[:, None, :] @ b[:, :, None])[:, 0, 0]
        mean = dot(p, x)
        variance, size = dot(p, (x - mean[:, None]) ** 2), 1 / dot(p, p)
        order = np.argsort(x, axis=1)
        ties = (np.diff(np.take_along_axis(x, order, 1), axis=1) == 0).any(axis=1)
        if ties.any():
            order[ties] = np.argsort(x[ties], axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        low, high = (x[every, order[every, np.minimum(np.count_nonzero(reach < q, axis=1), n - 1)]] for q in (self.alpha / 2, 1 - self.alpha / 2))
        few = np.flatnonzero(size < self.threshold * n)
        if len(few):
            # systematic draws: one uniform, equal steps along the weights
            draws = np.array([rngs[i].random() for i in few])
            x, w = x.copy(), w.copy()
            x[few], w[few] = _drawn(x[few], p[few], draws), 0.0
        return x, w, np.column_stack([mean, variance, low, high, size])


def _drawn(x: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Row by row, the particles at which the running weight reaches (draw + i) / n, for i below n."""
    n, u = x.shape[1], draws[:, None]
    reach = np.cumsum(p, axis=1)
    # how many of the steps lie at or below each running weight; the comparisons settle what rounding leaves open
    below = np.floor(reach * n - u)
    below += (u + below + 1) / n <= reach
    below -= (u + below) / n > reach
    upto = np.clip(below + 1, 0, n).astype(np.int64)
    upto[:, -1] = n
    return np.repeat(x.ravel(), np.diff(upto, axis=1, prepend=0).ravel()).reshape(x.shape)


OUT = ["mean", "variance", "low", "high", "effective"]


def _schema(df: DataFrame, key: str, order: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, " + ", ".join(f"{c} double" for c in OUT)


def _plain(v):
    return None if pd.isna(v) else v


def _cols(estimates: DataFrame, key: str, order: str, estimate: str, se: str) -> DataFrame:
    return estimates.select(key, order, F.col(key).cast("string").alias("__k"), F.col(estimate).cast("double").alias("__e"), F.col(se).cast("double").alias("__s"))


def particle_batch(estimates: DataFrame, key: str, order: str, estimate: str, se: str, **how) -> DataFrame:
    """(key, order, mean, variance, low, high, effective) after each estimate of a key, in ``order``.

    Rows are sorted by key and order within partitions of about ``ROWS`` rows and read batch by batch; a task holds the
    particles of some keys, which move together, never its rows, however many they are.  A null key is a key.  Rows of one
    key with equal ``order`` stand in any order.
    """
    f = Filter(**how)
    together = max(1, TOGETHER // f.n)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for rows in frames:
            if rows.empty:
                continue
            e, s, out = rows["__e"].to_numpy(dtype=float), rows["__s"].to_numpy(dtype=float), np.empty((len(rows), len(OUT)))
            names = [_plain(k) for k in rows["__k"]]
            starts = [i for i, k in enumerate(names) if not i or k != names[i - 1]]
            runs = [(names[i], i, j) for i, j in zip(starts, [*starts[1:], len(rows)])]
            # longest first: keys of like length move together, and those with rows left stand in front
            runs, new = sorted(runs, key=lambda r: r[1] - r[2]), None
            for at in range(0, len(runs), together):
                some = runs[at : at + together]
                states = [held if held is not None and i == 0 and k == last else f.start(k) for k, i, _ in some]
                x, w = np.stack([v[0] for v in states]), np.stack([v[1] for v in states])
                keys, row = [r[0] for r in some], [v[2] for v in states]
                first, length = np.array([r[1] for r in some]), np.array([r[2] - r[1] for r in some])
                for step in range(length[0]):
                    m = np.count_nonzero(length > step)
                    here = first[:m] + step
                    if m < FEW:
                        for i, r in enumerate(here):
                            (x[i], w[i], _), out[r] = f.step(keys[i], (x[i], w[i], row[i] + step), float(e[r]), float(s[r]))
                    else:
                        x[:m], w[:m], out[here] = f.steps(keys[:m], [r + step for r in row[:m]], x[:m], w[:m], e[here], s[here])
                for i, (k, _, to) in enumerate(some):
                    if to == len(rows):
                        new = k, (x[i].copy(), w[i].copy(), row[i] + int(length[i]))
            last, held = new
            yield pd.concat([rows[[key, order]].reset_index(drop=True), pd.DataFrame(out, columns=OUT)], axis=1)

    d = spread(_cols(estimates, key, order, estimate, se), ["__k"], ROWS)
    return d.sortWithinPartitions("__k", order).mapInPandas(walk, _schema(estimates, key, order))


def particle_stream(estimates: DataFrame, key: str, order: str, estimate: str, se: str, **how) -> DataFrame:
    """The same fold on a stream: the state of a key is its particles and weights; rows of a batch go in their order."""
    f = Filter(**how)

    def fold(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        k = _plain(name[0])
        rows = pd.concat(list(frames)).sort_values(order)
        held = state.get if state.exists else None
        now = f.start(k) if held is None else (np.frombuffer(held[0]), np.frombuffer(held[1]), held[2])
        out = []
        for e, s in zip(rows["__e"], rows["__s"]):
            now, r = f.step(k, now, _plain(e), _plain(s))
            out.append(r)
        state.update((now[0].tobytes(), now[1].tobytes(), now[2]))
        yield pd.concat([rows[[key, order]].reset_index(drop=True), pd.DataFrame(out, columns=OUT, dtype=float)], axis=1)

    return _cols(estimates, key, order, estimate, se).groupBy("__k").applyInPandasWithState(fold, _schema(estimates, key, order), "x binary, w binary, row int", "append", "NoTimeout")
