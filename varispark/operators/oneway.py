"""One-factor models from sufficient statistics: one grouped pass over the data, whatever its size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_stats(df: DataFrame, factor: str, y: Column) -> DataFrame:
    """level, n, mean, ss (within sum of squares); incomplete rows are dropped."""
    rows = df.select(F.col(factor).alias("level"), y.cast("double").alias("y")).where("level is not null and y is not null and not isnan(y)")
    stats = rows.groupBy("level").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("v"))
    return stats.select("level", "n", "mean", (F.col("v") * F.col("n")).alias("ss"))


def _summed(stats: DataFrame, su2: Column, se2: Column, *by: str) -> DataFrame:
    w = F.col("n") / (se2 + F.col("n") * su2)
    return stats.groupBy(*by).agg(
        F.sum("n").alias("obs"), F.sum((F.col("n") - 1) * F.log(se2) + F.log(se2 + F.col("n") * su2)).alias("logdet"),
        F.sum(w).alias("w"), F.sum(w * F.col("mean")).alias("wm"), F.sum(w * F.col("mean") * F.col("mean")).alias("wmm"), (F.sum("ss") / F.first(se2)).alias("within"),
    )


def _neg2(s: DataFrame) -> Column:
    return (F.col("obs") - 1) * math.log(2 * math.pi) + F.col("logdet") + F.log("w") + F.col("within") + F.col("wmm") - F.col("wm") * F.col("wm") / F.col("w")


def neg2_loglik(stats: DataFrame, su2: float, se2: float) -> DataFrame:
    """-2 log restricted likelihood at given variances, with the number of observations and the mean."""
    s = _summed(stats, F.lit(su2), F.lit(se2))
    return s.select("obs", (F.col("wm") / F.col("w")).alias("mu"), _neg2(s).alias("neg2"))


def profile_grid(stats: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """-2 log likelihood at each pair of variances, ranked; each row of statistics is expanded over the grid."""
    points = F.array(*[F.struct(F.lit(k).alias("point"), F.lit(float(a)).alias("su2"), F.lit(float(b)).alias("se2")) for k, (a, b) in enumerate(grid)])
    rows = stats.select("n", "mean", "ss", F.inline(points))
    s = _summed(rows, F.col("su2"), F.col("se2"), "point", "su2", "se2")
    out = s.select("point", "su2", "se2", _neg2(s).alias("neg2"))
    from pyspark.sql import Window

    return out.withColumn("rank", F.row_number().over(Window.orderBy("neg2", "point")))


def blup(stats: DataFrame, su2: float, se2: float) -> DataFrame:
    """level, n, u (best linear unbiased prediction) and pev of each level."""
    mu = neg2_loglik(stats, su2, se2).select("mu")
    shrink = F.col("n") * su2 / (se2 + F.col("n") * su2)
    w = F.col("n") / (F.lit(se2) + F.col("n") * su2)
    total = stats.agg(F.sum(w).alias("w"))
    both = stats.join(F.broadcast(mu), how="cross").join(F.broadcast(total), how="cross")  # one row each
    pev = su2 * (1 - shrink) + shrink * shrink / F.col("w")
    return both.select("level", "n", (shrink * (F.col("mean") - F.col("mu"))).alias("u"), pev.alias("pev"))


def effective_dimension(stats: DataFrame, su2: float, se2: float) -> DataFrame:
    """q, ed = q - trace(PEV) / variance, and the generalised heritability ed / (q - 1)."""
    b = blup(stats, su2, se2).agg(F.count("*").alias("q"), F.sum("pev").alias("trace"))
    ed = F.col("q") - F.col("trace") / su2
    return b.select("q", ed.alias("ed"), (ed / (F.col("q") - 1)).alias("h2"))


def anova(stats: DataFrame) -> DataFrame:
    """Between and within mean squares and the variance components that equate them to their expectations."""
    s = stats.agg(F.count("*").alias("q"), F.sum("n").alias("obs"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("mean")).alias("t"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("tt"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    msb = (F.col("tt") - F.col("t") * F.col("t") / F.col("obs")) / (F.col("q") - 1)
    msw = F.col("ssw") / (F.col("obs") - F.col("q"))
    n0 = (F.col("obs") - F.col("nn") / F.col("obs")) / (F.col("q") - 1)
    return s.select(msb.alias("ms_between"), msw.alias("ms_within"), ((msb - msw) / n0).alias("var_between"), msw.alias("var_within"))


def fitted(df: DataFrame, stats: DataFrame, factor: str, y: Column, su2: float, se2: float) -> DataFrame:
    """Complete rows of df with their fitted values and residuals; rows without a level or a response have none and go."""
    effects = blup(stats, su2, se2).join(F.broadcast(neg2_loglik(stats, su2, se2).select("mu")), how="cross").select("level", (F.col("mu") + F.col("u")).alias("fitted"))
    out = df.join(effects, F.col(factor) == F.col("level")).drop("level").withColumn("resid", y - F.col("fitted"))
    return out.where("resid is not null and not isnan(resid)")
