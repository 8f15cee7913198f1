"""Streaming: windowed arm means, sessions, and a Kalman fold of estimates, with batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, value: str, by: list[str], width: str = "10 minutes", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums per time window and group; on a stream, rows later than ``late`` are dropped by the watermark."""
    d = events.withWatermark(time, late) if events.isStreaming and late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_effect(events: DataFrame, time: str, value: str, arm: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Difference of arm means per window."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    one, zero = F.when(F.col(arm) == 1, F.col(value)), F.when(F.col(arm) == 0, F.col(value))
    w = d.groupBy(F.window(time, width).alias("w")).agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), F.count(one).alias("n1"), F.count(zero).alias("n0"))
    return w.select(F.col("w.start").alias("start"), (F.col("m1") - F.col("m0")).alias("effect"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("std_error"), "n1", "n0")


def kalman_batch(estimates: DataFrame, key: str, order: str, estimate: str, se: str, prior_mean: float = 0.0, prior_var: float = 1.0) -> DataFrame:
    """Posterior mean and variance after each estimate, constant state: running sums of precisions."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = F.lit(1 / prior_var) + F.sum(1 / F.col(se) ** 2).over(w)
    m = F.lit(prior_mean / prior_var) + F.sum(F.col(estimate) / F.col(se) ** 2).over(w)
    return estimates.select(key, order, (m / p).alias("mean"), (1 / p).alias("variance"))


def kalman_stream(estimates: DataFrame, key: str, order: str, estimate: str, se: str, prior_mean: float = 0.0, prior_var: float = 1.0, process_var: float = 0.0) -> DataFrame:
    """Stateful fold per key: the state is the posterior mean and variance; rows of a batch go in their order."""

    def fold(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, var = state.get if state.exists else (prior_mean, prior_var)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, e, s in zip(rows[order], rows[estimate], rows[se]):
            var += process_var
            gain = var / (var + s * s)
            mean, var = mean + gain * (e - mean), (1 - gain) * var
            out.append((name[0], o, mean, var))
        state.update((mean, var))
        yield pd.DataFrame(out, columns=[key, order, "mean", "variance"])

    kinds = {f.name: f.dataType.simpleString() for f in estimates.schema}
    return estimates.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, mean double, variance double", "mean double, variance double", "append", "NoTimeout")
