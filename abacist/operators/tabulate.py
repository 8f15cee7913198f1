"""Data preparation and tables: missing values, duplicates, panels, reshaping, recoding and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions.columns import num, uniform
from abacist.operators.core import quantiles


def _gone(df: DataFrame, c: str) -> Column:
    """Null, or NaN in a column that can hold it."""
    return F.col(c).isNull() | F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNull()


def missing_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: present, missing (null or NaN) and the share missing; one scan."""
    cols = cols or df.columns
    one = df.agg(F.count("*").alias("__n"), *[F.count(F.when(_gone(df, c), 1)).alias(c) for c in cols])
    long = one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing")) for c in cols])).alias("v"))
    return long.select("v.variable", (F.col("__n") - F.col("v.missing")).alias("present"), "v.missing", F.when(F.col("__n") > 0, F.col("v.missing") / F.col("__n")).alias("share"))


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per pattern of presence, as a string of + and . in the order of ``cols``."""
    return df.groupBy(F.concat(*[F.when(_gone(df, c), ".").otherwise("+") for c in cols]).alias("pattern")).agg(F.count("*").alias("n"))


def codebook(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: type, distinct values (exact), smallest and largest as text."""
    kinds = dict(df.dtypes)
    parts = [df.agg(F.lit(c).alias("variable"), F.lit(kinds[c]).alias("type"), F.count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys come how often, and the surplus rows."""
    copies = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    return copies.groupBy("copies").agg(F.count("*").alias("keys"), F.sum(F.col("copies") - 1).alias("surplus"))


def panel_describe(df: DataFrame, unit: str, time: str) -> DataFrame:
    """Units, periods, rows, balance, and between and within counts of a panel, as one row."""
    per = df.select(unit, time).dropna().groupBy(unit).agg(F.count("*").alias("n"), F.count_distinct(time).alias("t"), F.min(time).alias("a"), F.max(time).alias("b"))
    periods = df.select(F.count_distinct(time).alias("periods"))
    one = per.agg(F.count("*").alias("units"), F.sum("n").alias("rows"), F.min("t").alias("least"), F.max("t").alias("most"), F.avg("t").alias("mean"), F.sum(F.col("n") - F.col("t")).alias("repeated"))
    return one.crossJoin(F.broadcast(periods)).withColumn("balanced", (F.col("least") == F.col("periods")) & (F.col("repeated") == 0))  # one row on either side


def within_between(df: DataFrame, y: str, unit: str) -> DataFrame:
    """Overall, between-unit and within-unit standard deviations of y."""
    d = df.select(F.col(unit).alias("u"), num(y).alias("y")).dropna()
    per = d.groupBy("u").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    total = F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / total
    ss_w, ss_b = F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.col("m") ** 2) - total * grand**2
    return per.agg(grand.alias("mean"), F.sqrt((ss_w + ss_b) / (total - 1)).alias("overall"), F.stddev("m").alias("between"), F.sqrt(ss_w / (total - 1)).alias("within"))


def fill_in(df: DataFrame, unit: str, time: str) -> DataFrame:
    """A row for every unit and every period that the table has; ``_filled`` marks new ones.  Grows with units times periods, as asked."""
    grid = df.select(unit).distinct().crossJoin(F.broadcast(df.select(time).distinct()))  # periods: few
    return grid.join(df.withColumn("_filled", F.lit(False)), [unit, time], "left").withColumn("_filled", F.col("_filled").isNull())


def margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cross-table with both margins; a margin is the text ``Total``."""
    name = lambda c: F.when(F.grouping(c) == 1, F.lit("Total")).otherwise(F.col(c).cast("string"))
    return df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).cube(row, col).agg(name(row).alias("row"), name(col).alias("column"), F.count("*").alias("n")).select("row", "column", "n")


def pivot(df: DataFrame, index: str, columns: str, values: str, levels: list) -> DataFrame:
    """Means of ``values``: a row per index, a column per level; the levels are given, so that the plan is one pass."""
    return df.groupBy(index).pivot(columns, levels).agg(F.avg(values))


def longer(df: DataFrame, keep: list[str], cols: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; nulls stay."""
    return df.unpivot(keep, cols, name, value)


def standardise(df: DataFrame, cols: list[str], by: list[str] = []) -> DataFrame:
    """Adds ``z_<col>``: distance from the group mean in standard deviations (null without spread).

    The groups' moments are aggregated and joined, so a large group needs no window.
    """
    keys = [F.col(b).alias(f"__by_{b}") for b in by]
    m = df.groupBy(*keys).agg(*[f(num(c)).alias(f"__{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev))])
    met = reduce(lambda a, b: a & b, [df[b].eqNullSafe(m[f"__by_{b}"]) for b in by], F.lit(True))
    j = df.join(m, met) if by else df.crossJoin(F.broadcast(m))  # one row
    return j.select(*[df[c] for c in df.columns], *[F.when(F.col(f"__s_{c}") > 0, (num(df[c]) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(f"z_{c}") for c in cols])


def cut(col: str, edges: list[float], right: bool = True) -> Column:
    """Number of the interval between ascending edges, from 1; null outside."""
    x = num(col)
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:]), 1):
        out = F.when((x > a) & (x <= b) if right else (x >= a) & (x < b), F.lit(i)).otherwise(out)
    return out


def quantile_groups(df: DataFrame, col: str, groups: int, name: str = "quantile") -> DataFrame:
    """Adds the number of the quantile group (exact cuts; a value at a cut belongs below)."""
    cuts = quantiles(df, [col], [i / groups for i in range(1, groups)]).first()[0] or []
    at = F.lit(1)
    for c in sorted(set(cuts)):
        at = at + (num(col) > F.lit(c)).cast("int")
    return df.withColumn(name, F.when(num(col).isNotNull(), at))


def dummies(df: DataFrame, col: str, levels: list) -> DataFrame:
    """Adds a 0/1 column per level but the first; null stays null."""
    return df.withColumns({f"{col}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in levels[1:]})


# ---------------------------------------------------------------- imputation
def impute(df: DataFrame, cols: list[str], how: str = "mean", by: list[str] = []) -> DataFrame:
    """Missing values by the group's mean or median (exact); groups without a value stay missing."""
    keys = [F.col(b).alias(f"__by_{b}") for b in by]
    if how == "mean":
        m = df.groupBy(*keys).agg(*[F.avg(num(c)).alias(f"__m_{c}") for c in cols])
    elif how == "median":
        m = quantiles(df, cols, [0.5], by).select(*keys, *[F.col(f"q_{c}")[0].alias(f"__m_{c}") for c in cols])
    else:
        raise ValueError(how)
    met = reduce(lambda a, b: a & b, [df[b].eqNullSafe(m[f"__by_{b}"]) for b in by], F.lit(True))
    j = df.join(m, met, "left") if by else df.crossJoin(F.broadcast(m))  # one row
    return j.select(*[F.coalesce(num(df[c]), F.col(f"__m_{c}")).alias(c) if c in cols else df[c] for c in df.columns])


def carry_forward(df: DataFrame, cols: list[str], unit: str, time: str) -> DataFrame:
    """Missing values by the unit's last one before."""
    w = Window.partitionBy(unit).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(num(c), ignorenulls=True).over(w) for c in cols})


def hot_deck(df: DataFrame, col: str, cells: list[str], keys: list[str], donors: int = 64, seed: int = 0) -> DataFrame:
    """Missing values by those of donors of the same cell, drawn by a hash of the row's keys.

    Donors of a cell are spread by hash over ``donors`` slots, and each slot keeps the one with the
    smallest hash: a cell of any size gives at most that many rows, and no row meets all others.
    """
    d = df.withColumn("__slot", (uniform(seed, *keys) * donors).cast("int"))
    own = d.where(num(col).isNotNull()).groupBy(*cells, "__slot").agg(F.min_by(num(col), uniform(seed + 1, *keys)).alias("__value"))
    ring = own.groupBy(*[F.col(c).alias(f"__c_{c}") for c in cells]).agg(F.sort_array(F.collect_list(F.struct("__slot", "__value"))).alias("__ring"))
    met = reduce(lambda a, b: a & b, [d[c].eqNullSafe(ring[f"__c_{c}"]) for c in cells])
    drawn = F.get("__ring", F.pmod(F.col("__slot"), F.size("__ring")))["__value"]
    return d.join(ring, met, "left").select(*[F.coalesce(num(d[c]), drawn).alias(c) if c == col else d[c] for c in df.columns])
