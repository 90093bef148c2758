"""Genome-scan tables: one-degree tests per locus, genomic control, thresholds, hits and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Median of chi-square with one degree of freedom, a fixed value.
MEDIAN_CHI2 = 0.4549364231195724


def scan_ols(markers: DataFrame, phenotype: DataFrame, se2: float) -> DataFrame:
    """snp, beta, chi2 with V = se2 I and an intercept, from sums per locus. markers: snp, gen, dose; phenotype: gen, y."""
    s = markers.join(phenotype, "gen").groupBy("snp").agg(
        F.count("*").alias("n"), F.sum("dose").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("dose") * F.col("dose")).alias("sxx"), F.sum(F.col("dose") * F.col("y")).alias("sxy")
    )
    num = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    den = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    return s.select("snp", num.alias("num"), den.alias("den")).where("den > 0").select("snp", (F.col("num") / F.col("den")).alias("beta"), (F.col("num") * F.col("num") / F.col("den") / se2).alias("chi2"))


def exact_median(values: DataFrame, column: str) -> DataFrame:
    """One row with the median of a column: only the values near it, about two in a thousand, are sorted."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    some = v.agg(F.percentile_approx("v", F.array(F.lit(0.499), F.lit(0.501)), F.lit(20_000)).alias("at"), F.count("*").alias("n"))  # one row
    near = v.join(F.broadcast(some), how="cross")
    below = near.agg(F.count(F.when(F.col("v") < F.element_at("at", 1), 1)).alias("below"))
    inner = near.where((F.col("v") >= F.element_at("at", 1)) & (F.col("v") <= F.element_at("at", 2))).join(F.broadcast(below), how="cross")
    place = F.row_number().over(Window.orderBy("v")) + F.col("below")
    ranked = inner.select("v", "n", place.alias("place"))
    return ranked.where((F.col("place") == F.floor((F.col("n") + 1) / 2)) | (F.col("place") == F.floor(F.col("n") / 2) + 1)).agg(F.avg("v").alias("median"))


def lambda_gc(tests: DataFrame) -> DataFrame:
    """Median of the tests over that of chi-square with one degree of freedom."""
    return exact_median(tests, "chi2").select((F.col("median") / MEDIAN_CHI2).alias("lambda_gc"))


def threshold(tests: DataFrame, alpha: float) -> DataFrame:
    """Bonferroni threshold over the finite tests."""
    return tests.agg((F.lit(alpha) / F.count(F.when(F.col("chi2").isNotNull() & ~F.isnan("chi2"), 1))).alias("threshold"))


def top_hits(tests: DataFrame, k: int) -> DataFrame:
    """The k largest tests; ties go to the smaller locus."""
    return tests.orderBy(F.desc("chi2"), "snp").limit(k)


def best_per_group(tests: DataFrame, group: str) -> DataFrame:
    """The largest test of each group and the locus that has it."""
    return tests.groupBy(group).agg(F.max("chi2").alias("chi2"), F.max_by("snp", F.struct("chi2", -F.col("snp"))).alias("snp"))


def histogram(tests: DataFrame, width: float) -> DataFrame:
    return tests.groupBy(F.floor(F.col("chi2") / width).alias("bin")).agg(F.count("*").alias("n"))


def ar1_parts(series: DataFrame, key: str, order: str, y: str) -> DataFrame:
    """For each series: n, and the sums that make y'K^-1 y for any correlation of neighbours: a = y'y, d = the inner
    positions' y'y, t = twice the sum of neighbours' products."""
    w = Window.partitionBy(key).orderBy(order)
    s = series.select(F.col(key).alias("series"), F.col(y).alias("y"), F.lag(y).over(w).alias("before"), F.lead(y).over(w).alias("after"))
    yy = F.col("y") * F.col("y")
    inner = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), yy).otherwise(0.0)
    return s.groupBy("series").agg(F.count("*").alias("n"), F.sum(yy).alias("a"), F.sum(inner).alias("d"), F.sum(F.coalesce(2 * F.col("y") * F.col("before"), F.lit(0.0))).alias("t"))


def ar1_form(parts: DataFrame, rho: float) -> DataFrame:
    """Quadratic form and log determinant of each series under correlation rho between neighbours."""
    quad = F.when(F.col("n") == 1, F.col("a")).otherwise((F.col("a") + rho * rho * F.col("d") - rho * F.col("t")) / (1 - rho * rho))
    return parts.select("series", "n", quad.alias("quad"), ((F.col("n") - 1) * F.log(F.lit(1 - rho * rho))).alias("logdet"))


def marginal_means(df: DataFrame, factor: str, over: str, y: str, weights: str = "equal") -> DataFrame:
    """Means of a factor's levels averaged over another's, with equal weights or by its frequencies."""
    cells = df.groupBy(F.col(factor).alias("level"), F.col(over).alias("other")).agg(F.avg(y).alias("m"))
    if weights == "equal":
        return cells.groupBy("level").agg(F.avg("m").alias("mean"))
    share = df.groupBy(F.col(over).alias("other")).agg(F.count("*").alias("w"))
    return cells.join(share, "other").groupBy("level").agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("mean"))
