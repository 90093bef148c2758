"""Summaries of fits as DataFrame plans: correlation intervals, shares, grids of fits, convergence of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varispark.functions.special import normal_ppf


def cor_interval(df: DataFrame, r: str, n: str | None = None, se: str | None = None, level: float = 0.95, width_max: float | None = 1.5, clamp: float = 0.999999) -> DataFrame:
    """df with a correlation's interval on Fisher's scale: z_fisher, se_z, ci_low, ci_high, width, informative.

    Give either the correlation's standard error (se_z = se / (1 - r^2)) or its number of pairs (1 / sqrt(n - 3)); three
    pairs or fewer, or a null, give nulls.
    """
    if (n is None) == (se is None):
        raise ValueError("give either n or se")
    x = F.col(r)
    se_z = F.when(F.col(n) > 3, 1 / F.sqrt(F.col(n) - 3.0)) if n else F.col(se) / F.greatest(1 - x * x, F.lit(1e-8))
    out = df.withColumn("z_fisher", F.atanh(F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp)))).withColumn("se_z", se_z)
    q = normal_ppf(0.5 + level / 2)
    out = out.withColumn("ci_low", F.tanh(F.col("z_fisher") - q * F.col("se_z"))).withColumn("ci_high", F.tanh(F.col("z_fisher") + q * F.col("se_z")))
    out = out.withColumn("width", F.col("ci_high") - F.col("ci_low"))
    return out.withColumn("informative", F.col("width") <= width_max if width_max is not None else F.lit(None).cast("boolean"))


def shares(components: DataFrame, by: str, value: str) -> DataFrame:
    """Variance components with their share of each target's total."""
    return components.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(by)))


def ratio_se(v1: Column, v2: Column, var1: Column, var2: Column, cov: Column) -> Column:
    """Standard error of v1 / (v1 + v2) by the delta method."""
    return F.sqrt(v2 * v2 * var1 + v1 * v1 * var2 - 2 * v1 * v2 * cov) / F.pow(v1 + v2, F.lit(2))


def grid_delta(table: DataFrame, coords: list[str], by: list[str] | None = None, aic: str = "aic", tol: float = 2.0) -> DataFrame:
    """Fits of a grid with delta_aic against their group's best, and whether they are supported (delta_aic <= tol).

    Without an aic column it is 2 n_par - 2 loglik; fits without a finite one have null and aren't supported.
    """
    rows = table if aic in table.columns else table.withColumn(aic, 2 * F.col("n_par") - 2 * F.col("loglik"))
    finite = F.when(~F.isnan(aic) & (F.abs(aic) < float("inf")), F.col(aic))
    least = F.min(finite).over(Window.partitionBy(*(by or [F.lit(0)])))
    return rows.withColumn("delta_aic", finite - least).withColumn("supported", F.coalesce(F.col("delta_aic") <= tol, F.lit(False)))


def grid_summary(table: DataFrame, coords: list[str], by: list[str] | None = None, aic: str = "aic", tol: float = 2.0) -> DataFrame:
    """One row per group: best aic and its coordinates, number supported, each coordinate's supported range, cells
    missing from the product of coordinates, repeated cells; with pd_hessian the best of those fits and its distance."""
    rows = grid_delta(table, coords, by, aic, tol)
    key, sup = F.struct(*coords), F.col("supported")
    best = F.min_by(key, F.struct(F.col("delta_aic").isNull(), "delta_aic", key))
    product = F.lit(1)
    for c in coords:
        product = product * F.count_distinct(c)
    aggs = [F.min(F.when(F.col("delta_aic").isNotNull(), F.col(aic))).alias("best_aic"), best.alias("best"), F.count(F.when(sup, 1)).alias("n_supported"), F.count("*").alias("n_cells")]
    for c in coords:
        aggs += [F.min(F.when(sup, F.col(c))).alias(f"{c}_min"), F.max(F.when(sup, F.col(c))).alias(f"{c}_max")]
    aggs += [(product - F.count_distinct(*coords)).alias("n_missing"), (F.count("*") - F.count_distinct(*coords)).alias("n_repeated")]
    if "pd_hessian" in table.columns:
        aggs += [F.min(F.when(F.col("pd_hessian"), F.col("delta_aic"))).alias("delta_pd"), F.count(F.when(~F.col("pd_hessian"), 1)).alias("n_pd_false")]
    if "n_at_bound" in table.columns:
        aggs.append(F.count(F.when(F.col("n_at_bound") > 0, 1)).alias("n_at_bound"))
    out = rows.groupBy(*(by or [])).agg(*aggs)
    return out.select(*(by or []), "best_aic", *[F.col(f"best.{c}").alias(f"best_{c}") for c in coords], *[c for c in out.columns if c not in {*(by or []), "best_aic", "best"}])


def split_chains(draws: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """draws with the half of its chain that each belongs to; the middle draw of an odd number belongs to the second."""
    w = Window.partitionBy(chain)
    k, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return draws.withColumn("half", F.when(k <= F.floor(n / 2), 0).otherwise(1))


def rhat(draws: DataFrame, chain: list[str], x: str) -> DataFrame:
    """Potential scale reduction of chains: chains, n (draws of a chain, on average), within, between, rhat."""
    per = draws.groupBy(*chain).agg(F.count("*").alias("k"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    s = per.agg(F.count("*").alias("chains"), F.avg("k").alias("n"), F.avg("v").alias("within"), F.var_samp("m").alias("between"))
    return s.withColumn("rhat", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.col("within")))


def weighted_sums(df: DataFrame, by: list[str], w: str, y: Column) -> DataFrame:
    """What prior weights leave of rows scaled by their roots: n, sum log w, sum w, sum w y, sum w y^2; w must be positive."""
    rows = df.select(*by, F.col(w).alias("w"), y.cast("double").alias("y")).where("w > 0 and y is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.log("w")).alias("log_w"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"))


def hat_basis(df: DataFrame, x: str, low: float, high: float, nseg: int) -> DataFrame:
    """Sums over rows of the linear B-splines on equal segments: knot, s, ss. A row has at most two non-zero entries."""
    at = (F.col(x) - low) * nseg / (high - low)
    left = F.least(F.floor(at), F.lit(nseg - 1).cast("long"))
    entries = F.array(F.struct(left.alias("knot"), (1 - (at - left)).alias("v")), F.struct((left + 1).alias("knot"), (at - left).alias("v")))
    rows = df.where(F.col(x).between(low, high)).select(F.inline(entries)).where("v <> 0")
    return rows.groupBy("knot").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def spherical(h: Column, reach: float) -> Column:
    s = h / reach
    return F.when(s < 1, 1 - 1.5 * s + 0.5 * s * s * s).otherwise(0.0)


def matern_half(h: Column, phi: float) -> Column:
    """Matern's correlation of smoothness one half."""
    return F.exp(-h / phi)


def separable_pairs(dr: Column, dc: Column, rho_r: float, rho_c: float) -> Column:
    return F.pow(F.lit(rho_r), F.abs(dr)) * F.pow(F.lit(rho_c), F.abs(dc))
