"""Target-trial emulation: clones by strategy, artificial censoring, and weights for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.operators.core import DataInsufficient
from abacist.operators.panel import written
from abacist.operators.regression import glm


def clone_censor_weight(df: DataFrame, unit: str, time: str, strategies: dict[str, Column], covariates: list[str], *, stabilise: bool = True, intervals: bool = True) -> DataFrame:
    """The rows of each unit's clones that still follow their strategy, with ``strategy``, ``censored`` and ``weight``.

    ``strategies`` says of each row whether it agrees with the strategy; a null does not.  A clone leaves before its first row
    that does not agree; a unit whose first row does not agree has no clone.  ``censored`` is 1 on the last row before
    that.  With ``intervals`` a logit per strategy gives each row's chance to leave next, and a row's weight is the product
    over the clone's earlier rows of one over the chance to stay, times the strategy's share that stays if ``stabilise``.
    Without, as pooled models do it, the chance is that of a clone's row to belong to a clone that never leaves.
    Rows with a null covariate, unit or time drop.  A strategy that no row leaves has weights of one.
    """
    names = list(strategies)
    d = df.dropna(subset=[unit, time, *covariates]).withColumns({f"__s{k}": F.coalesce(c, F.lit(False)) for k, c in enumerate(strategies.values())})
    clones = d.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"__s{k}").alias("ok")) for k, n in enumerate(names)])))
    clones = clones.select(*df.columns, F.col("__c.strategy").alias("strategy"), F.col("__c.ok").alias("__ok"))
    along = Window.partitionBy(unit, "strategy").orderBy(time)
    so_far, earlier, whole = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(unit, "strategy")
    marked = clones.withColumns({"__follows": F.min("__ok").over(so_far), "__next": F.lead("__ok").over(along)}).where("__follows")
    marked = marked.withColumn("censored", F.coalesce((~F.col("__next")).cast("int"), F.lit(0)))
    marked = marked.withColumn("__left", F.max("censored").over(whole))
    kept = written(marked, df.sparkSession)
    out = None
    for n in names:
        own = kept.where(F.col("strategy") == n)
        # the last row of a clone's data says nothing about leaving
        at_risk, gone = (own.where("__next is not null"), "censored") if intervals else (own, "__left")
        rows, left = at_risk.agg(F.count("*"), F.sum(gone)).first()
        ratio = F.lit(1.0)
        if rows and left:
            if left == rows:
                raise DataInsufficient(f"every row leaves the strategy {n}")
            stay = 1 / (1 + F.exp(glm(at_risk.withColumn("__y", F.col(gone).cast("double")), "__y", covariates).predict({c: F.col(c) for c in covariates})))
            ratio = (1 - left / rows if stabilise else 1.0) / F.greatest(stay, F.lit(1e-6))
        log = F.when(F.col("__next").isNotNull(), F.log(ratio)).otherwise(0.0)
        weight = F.exp(F.coalesce(F.sum(log).over(earlier), F.lit(0.0))) if intervals else ratio
        part = own.withColumn("weight", weight).select(*df.columns, "strategy", "censored", "weight")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no strategy is given")
    return out
