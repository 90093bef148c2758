"""Registered queries of the mixed-model operators on the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.operators import design, oneway, scans, summaries
from varispark.plans import engine_queries

SU2, SE2 = 0.05, 0.6
GRID = [(0.01, 0.5), (0.01, 0.7), (0.05, 0.5), (0.05, 0.6), (0.05, 0.7), (0.2, 0.6)]
RHO, PSI = 0.4, 0.3


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def _stats(spark, sf):
    return oneway.group_stats(_t(spark, sf, "lineitem"), "l_suppkey", F.log("l_extendedprice"))


_STATS = "st AS (SELECT l_suppkey AS level, count(*) AS n, avg(ln(l_extendedprice)) AS mean, var_pop(ln(l_extendedprice)) * count(*) AS ss FROM lineitem WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1)"
_NEG2 = "(sum(n) - 1) * ln(2 * pi()) + sum((n - 1) * ln(se2) + ln(se2 + n * su2)) + ln(sum(n / (se2 + n * su2))) + sum(ss) / max(se2) + sum(n / (se2 + n * su2) * mean * mean) - sum(n / (se2 + n * su2) * mean) ** 2 / sum(n / (se2 + n * su2))"
_V = f"{SU2}e0 AS su2, {SE2}e0 AS se2"


def reml_oneway_fixed_theta(spark, sf):
    return _rounded(oneway.neg2_loglik(_stats(spark, sf), SU2, SE2))


def reml_oneway_profile_grid(spark, sf):
    return _rounded(oneway.profile_grid(_stats(spark, sf), GRID), 5)


def blup_oneway(spark, sf):
    return _rounded(oneway.blup(_stats(spark, sf), SU2, SE2), 8)


def pev_effective_dimension(spark, sf):
    return _rounded(oneway.effective_dimension(_stats(spark, sf), SU2, SE2))


def anova_variance_components(spark, sf):
    return _rounded(oneway.anova(_stats(spark, sf)))


def ols_normal_equations(spark, sf):
    x, y = F.col("l_quantity"), F.log("l_extendedprice")
    return _rounded(_t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")), 8)


def factor_levels_design(spark, sf):
    return design.level_table(_t(spark, sf, "customer"), "c_nationkey").withColumn("idx", F.col("idx").cast("long"))


def two_way_incidence_gram(spark, sf):
    return design.cross_gram(_t(spark, sf, "lineitem"), "l_suppkey", "l_partkey").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "x")


def gram_components(spark, sf):
    g = design.cross_gram(_t(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_returnflag")
    return g.select("l_returnflag", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "x")


def complete_cases(spark, sf):
    rows = _t(spark, sf, "lineitem").withColumn("y", F.when(F.col("l_quantity") > 5, F.log("l_extendedprice")))
    return design.complete_cases(rows, "y", "l_suppkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def long_format_unpivot(spark, sf):
    long = design.to_long(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])
    return _rounded(long.groupBy("trait").agg(F.count("*").alias("n"), F.avg("y").alias("mean")))


def trait_patterns(spark, sf):
    return design.trait_patterns(_t(spark, sf, "events"), "user_id", "event_type")


def _field(spark, sf):
    o = _t(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(F.floor(key / 900).alias("block"), key.alias("id"), (key % 30).alias("r"), (F.floor(key / 30) % 30).alias("c"), F.col("o_orderstatus").alias("grp"), (F.col("o_custkey") % 7).alias("level"), F.col("o_totalprice").alias("y"))


_FIELD = "u AS (SELECT o_orderkey // 900 AS block, o_orderkey AS id, o_orderkey % 30 AS r, (o_orderkey // 30) % 30 AS c, o_orderstatus AS grp, o_custkey % 7 AS level, o_totalprice AS y FROM orders)"
_NEAR = "nb AS (SELECT a.block, a.id AS src, b.id AS dst, b.grp AS to_grp, a.grp AS from_grp, b.level, sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) AS dist FROM u a JOIN u b ON a.block = b.block AND a.id <> b.id AND abs(a.r - b.r) <= {k} AND abs(a.c - b.c) <= {k})"
_W = "w AS (SELECT src, dst, 1.0e0 / count(*) OVER (PARTITION BY src) AS w FROM nb)"


def lattice_completion(spark, sf):
    rows = _field(spark, sf).where("grp <> 'F'")
    return design.lattice(rows, "r", "c", "block").groupBy("block", "observed").agg(F.count("*").alias("cells"))


def neighbour_weights(spark, sf):
    return _rounded(design.neighbour_weights(_field(spark, sf)))


def neighbourhood_level_incidence(spark, sf):
    return _rounded(design.neighbourhood(_field(spark, sf), 2, reach=1.0, dilution=0.5, receiver="O", emitter="F"))


def exposure_functionals(spark, sf):
    units = _field(spark, sf)
    own = units.select(F.col("id").alias("src"), "level", F.lit(1.0).alias("x"))
    return _rounded(design.exposure(design.neighbourhood(units, 2, reach=1.0), direct=own), 6)


def border_covariate(spark, sf):
    return _rounded(design.neighbour_border(_field(spark, sf), 0.125, 2))


def lag_ystar(spark, sf):
    return _rounded(design.neighbour_lagged(_field(spark, sf).withColumn("y", F.log("y")), PSI), 6)


def _markers(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("gen"), "label", F.posexplode("embedding").alias("snp", "v")).select("gen", "label", "snp", F.when(F.col("v") > 0.05, 2.0).when(F.col("v") > -0.05, 1.0).otherwise(0.0).alias("dose"))


_MARK = "m AS (SELECT vec_id AS gen, label, CAST(i - 1 AS INTEGER) AS snp, CASE WHEN embedding[i] > 5e-2 THEN 2e0 WHEN embedding[i] > -5e-2 THEN 1e0 ELSE 0e0 END AS dose FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_FREQ = "f AS (SELECT snp, count(*) AS n, avg(dose / 2) AS f FROM m GROUP BY 1)"


def maf_filter(spark, sf):
    return _rounded(design.maf_filter(_markers(spark, sf), 0.4))


def grm_vanraden(spark, sf):
    return design.grm(_markers(spark, sf), blend=0.01, digits=6)


def ld_r2_pairs(spark, sf):
    return _rounded(design.ld_pairs(_markers(spark, sf), 5))


def _tests(spark, sf):
    m = _markers(spark, sf)
    pheno = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("gen"), F.col("label").cast("double").alias("y"))
    return scans.scan_ols(m.drop("label"), pheno, 2.0)


_TEST = f"{_MARK}, s AS (SELECT snp, count(*) AS n, sum(dose) AS sx, sum(label) AS sy, sum(dose * dose) AS sxx, sum(dose * label) AS sxy FROM m GROUP BY 1), t AS (SELECT snp, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS beta, (sxy - sx * sy / n) ** 2 / (sxx - sx * sx / n) / 2e0 AS chi2 FROM s WHERE sxx - sx * sx / n > 0)"


def scan_ols_1df(spark, sf):
    return _rounded(_tests(spark, sf))


def lambda_gc(spark, sf):
    return _rounded(scans.lambda_gc(_tests(spark, sf)))


def bonferroni_threshold(spark, sf):
    return _rounded(scans.threshold(_tests(spark, sf), 0.05), 10)


def topk_hits(spark, sf):
    return _rounded(scans.top_hits(_tests(spark, sf).select("snp", "chi2"), 10))


def per_locus_best(spark, sf):
    return _rounded(scans.best_per_group(_tests(spark, sf).withColumn("chr", F.col("snp") % 4), "chr"))


def chi2_histogram(spark, sf):
    return scans.histogram(_tests(spark, sf), 0.5)


def ar1_precision_quadratic_form(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "value")
    return _rounded(scans.ar1_form(scans.ar1_parts(e, "user_id", "o", "value"), RHO), 4)


def predict_marginal_means_equal(spark, sf):
    return _rounded(scans.marginal_means(_t(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_extendedprice"), 4)


def predict_marginal_means_prop(spark, sf):
    return _rounded(scans.marginal_means(_t(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_extendedprice", "proportional"), 4)


def fisher_z_ci(spark, sf):
    r = _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n"))
    return _rounded(summaries.cor_interval(r, "r", n="n"))


def ratios_h2(spark, sf):
    long = oneway.anova(_stats(spark, sf)).select(F.lit("price").alias("target"), F.inline(F.array(F.struct(F.lit("supplier").alias("component"), F.col("var_between").alias("estimate")), F.struct(F.lit("residual").alias("component"), F.col("var_within").alias("estimate")))))
    return _rounded(summaries.shares(long, "target", "estimate"))


def delta_method_ratio_se(spark, sf):
    a = oneway.anova(_stats(spark, sf)).crossJoin(F.broadcast(_stats(spark, sf).agg(F.count("*").alias("q"), F.sum("n").alias("obs"), F.sum(F.col("n") * F.col("n")).alias("nn"))))  # one row each
    n0 = (F.col("obs") - F.col("nn") / F.col("obs")) / (F.col("q") - 1)
    vb, vw = 2 * F.pow("ms_between", F.lit(2)) / (F.col("q") - 1), 2 * F.pow("ms_within", F.lit(2)) / (F.col("obs") - F.col("q"))
    se = summaries.ratio_se(F.col("var_between"), F.col("var_within"), (vb + vw) / (n0 * n0), vw, -vw / n0)
    return _rounded(a.select((F.col("var_between") / (F.col("var_between") + F.col("var_within"))).alias("h2"), se.alias("se")), 8)


def aic_grid_summary(spark, sf):
    fits = oneway.profile_grid(_stats(spark, sf), GRID).select("su2", "se2", (-F.col("neg2") / 2).alias("loglik"), F.lit(3).alias("n_par"))
    return _rounded(summaries.grid_summary(fits, ["su2", "se2"]), 5)


def weighted_rows(spark, sf):
    return _rounded(summaries.weighted_sums(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", F.log("l_extendedprice")), 4)


def fitted_residuals(spark, sf):
    stats = _stats(spark, sf)
    return _rounded(oneway.fitted(_t(spark, sf, "lineitem"), stats, "l_suppkey", F.log("l_extendedprice"), SU2, SE2).select("l_orderkey", "l_linenumber", "fitted", "resid"))


def posterior_rhat(spark, sf):
    halves = summaries.split_chains(_t(spark, sf, "events").withColumnRenamed("user_id", "chain"), "chain", ["event_id"])
    return _rounded(summaries.rhat(halves, ["chain", "half"], "value"))


def spline_linear_basis(spark, sf):
    return _rounded(summaries.hat_basis(_t(spark, sf, "lineitem"), "l_quantity", 0.0, 60.0, 8), 4)


def matern_half_pairs(spark, sf):
    n = design.neighbours(_field(spark, sf))
    return _rounded(n.select("src", "dst", summaries.matern_half(F.col("dist"), 1.5).alias("r")))


def spherical_corr_pairs(spark, sf):
    n = design.neighbours(_field(spark, sf), 2)
    return _rounded(n.select("src", "dst", summaries.spherical(F.col("dist"), 2.5).alias("r")))


def separable_cov_pairs(spark, sf):
    n = design.neighbours(_field(spark, sf))
    return _rounded(n.select("src", "dst", summaries.separable_pairs(F.col("dr"), F.col("dc"), RHO, PSI).alias("r")))


def ld_prune(spark, sf):
    return design.ld_prune(_markers(spark, sf), 0.05, 5).select("snp")


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


_ORACLES = {
    "reml_oneway_fixed_theta": _sql(f"SELECT CAST(sum(n) AS BIGINT) AS obs, round(sum(n / (se2 + n * su2) * mean) / sum(n / (se2 + n * su2)), 6) AS mu, round({_NEG2}, 6) AS neg2 FROM (SELECT *, {_V} FROM st)", _STATS),
    "reml_oneway_profile_grid": _sql(
        f"SELECT point, su2, se2, round(neg2, 5) AS neg2, CAST(row_number() OVER (ORDER BY neg2, point) AS INTEGER) AS rank FROM (SELECT point, su2, se2, {_NEG2} AS neg2 FROM st, g GROUP BY point, su2, se2)",
        _STATS, "g AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}e0, {b}e0)" for k, (a, b) in enumerate(GRID)) + ") v(point, su2, se2))",
    ),
    "blup_oneway": _sql(
        "SELECT level, n, round(n * su2 / (se2 + n * su2) * (mean - mu), 8) AS u, round(su2 * (1 - n * su2 / (se2 + n * su2)) + (n * su2 / (se2 + n * su2)) ** 2 / w, 8) AS pev FROM v, mu",
        _STATS, f"v AS (SELECT *, {_V} FROM st)", "mu AS (SELECT sum(n / (se2 + n * su2) * mean) / sum(n / (se2 + n * su2)) AS mu, sum(n / (se2 + n * su2)) AS w FROM v)",
    ),
    "pev_effective_dimension": _sql(
        "SELECT count(*) AS q, round(count(*) - sum(pev) / max(su2), 6) AS ed, round((count(*) - sum(pev) / max(su2)) / (count(*) - 1), 6) AS h2 FROM (SELECT su2, su2 * (1 - n * su2 / (se2 + n * su2)) + (n * su2 / (se2 + n * su2)) ** 2 / w AS pev FROM v, mu)",
        _STATS, f"v AS (SELECT *, {_V} FROM st)", "mu AS (SELECT sum(n / (se2 + n * su2)) AS w FROM v)",
    ),
    "anova_variance_components": _sql(
        "SELECT round(msb, 6) AS ms_between, round(msw, 6) AS ms_within, round((msb - msw) / n0, 6) AS var_between, round(msw, 6) AS var_within FROM (SELECT (sum(n * mean * mean) - sum(n * mean) ** 2 / sum(n)) / (count(*) - 1) AS msb, sum(ss) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM st)", _STATS
    ),
    "ols_normal_equations": "SELECT l_returnflag, count(*) AS n, round(regr_slope(ln(l_extendedprice), l_quantity), 8) AS slope, round(regr_intercept(ln(l_extendedprice), l_quantity), 8) AS intercept, round(regr_r2(ln(l_extendedprice), l_quantity), 8) AS r2 FROM lineitem GROUP BY 1",
    "factor_levels_design": "SELECT c_nationkey AS level, row_number() OVER (ORDER BY c_nationkey) - 1 AS idx FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IS NOT NULL)",
    "two_way_incidence_gram": _sql(
        "SELECT i, j, CAST(count(*) AS DOUBLE) AS x FROM lineitem JOIN s USING (l_suppkey) JOIN p USING (l_partkey) GROUP BY i, j",
        "s AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS i FROM (SELECT DISTINCT l_suppkey FROM lineitem))", "p AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS j FROM (SELECT DISTINCT l_partkey FROM lineitem))",
    ),
    "gram_components": _sql(
        "SELECT l_returnflag, i, j, CAST(count(*) AS DOUBLE) AS x FROM lineitem JOIN s USING (l_suppkey) JOIN p USING (l_linenumber) GROUP BY 1, i, j",
        "s AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS i FROM (SELECT DISTINCT l_suppkey FROM lineitem))", "p AS (SELECT l_linenumber, row_number() OVER (ORDER BY l_linenumber) - 1 AS j FROM (SELECT DISTINCT l_linenumber FROM lineitem))",
    ),
    "complete_cases": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_extendedprice IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1",
    "long_format_unpivot": "SELECT trait, count(*) AS n, round(avg(y), 6) AS mean FROM (SELECT 'l_discount' AS trait, l_discount AS y FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1",
    "trait_patterns": "SELECT pattern, count(*) AS units FROM (SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS pattern FROM events GROUP BY 1) GROUP BY 1",
    "lattice_completion": _sql(
        "SELECT a.block, x.r IS NOT NULL AS observed, count(*) AS cells FROM a LEFT JOIN x ON a.block = x.block AND a.r = x.r AND a.c = x.c GROUP BY 1, 2",
        _FIELD, "x AS (SELECT DISTINCT block, r, c FROM u WHERE grp <> 'F')", "box AS (SELECT block, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM x GROUP BY 1)",
        "b AS (SELECT block, unnest(range(r0, r1 + 1)) AS r, c0, c1 FROM box)", "a AS (SELECT block, r, unnest(range(c0, c1 + 1)) AS c FROM b)",
    ),
    "neighbour_weights": _sql("SELECT src, dst, round(w, 6) AS w FROM w", _FIELD, _NEAR.format(k=1), _W),
    "neighbourhood_level_incidence": _sql(
        "SELECT src, level, round(sum(dist ** -1 / sqrt(n)), 6) AS x, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM nb WHERE from_grp = 'O' AND to_grp = 'F') GROUP BY src, level", _FIELD, _NEAR.format(k=2)
    ),
    "exposure_functionals": _sql(
        "SELECT count(*) AS rows, round(1e0, 6) AS d, round(avg(coalesce(ss, 0)), 6) AS k, round(avg(coalesce(ss, 0)), 6) AS k_identity, round(avg(coalesce(own, 0)), 6) AS c, round(avg(coalesce(s, 0)), 6) AS s, round(avg(coalesce(s, 0)) ** 2 / avg(coalesce(ss, 0)), 6) AS n_eff FROM u LEFT JOIN (SELECT src, sum(x) AS s, sum(x * x) AS ss, sum(CASE WHEN z.level = u.level THEN x ELSE 0 END) AS own FROM (SELECT src, level, sum(1 / dist) AS x FROM nb GROUP BY src, level) z JOIN u ON u.id = z.src GROUP BY src) k ON k.src = u.id",
        _FIELD, _NEAR.format(k=2),
    ),
    "border_covariate": _sql("SELECT nb.src AS id, round(sum(0.125e0 * x), 6) AS x FROM nb JOIN (SELECT src, sum(0.125e0) AS x FROM nb GROUP BY 1) o ON nb.dst = o.src GROUP BY 1", _FIELD, _NEAR.format(k=1)),
    "lag_ystar": _sql(f"SELECT u.id, round(ln(u.y) - {PSI}e0 * coalesce(wy, 0), 6) AS ystar FROM u LEFT JOIN (SELECT src, sum(w * ln(v.y)) AS wy FROM w JOIN u v ON w.dst = v.id GROUP BY 1) k ON u.id = k.src", _FIELD, _NEAR.format(k=1), _W),
    "maf_filter": _sql("SELECT snp, n, round(f, 6) AS f, round(least(f, 1 - f), 6) AS maf FROM f WHERE least(f, 1 - f) >= 4e-1", _MARK, _FREQ),
    "grm_vanraden": _sql(
        "SELECT a.gen AS i, b.gen AS j, round(99e-2 * sum(a.z * b.z) / max(scale) + CASE WHEN a.gen = b.gen THEN 1e-2 ELSE 0 END, 6) AS k FROM z a JOIN z b ON a.snp = b.snp AND a.gen <= b.gen, (SELECT sum(2 * f * (1 - f)) AS scale FROM f) GROUP BY a.gen, b.gen",
        _MARK, _FREQ, "z AS (SELECT m.snp, gen, dose - 2 * f AS z FROM m JOIN f ON m.snp = f.snp)",
    ),
    "ld_r2_pairs": _sql("SELECT a.snp AS a, b.snp AS b, round(corr(a.dose, b.dose) ** 2, 6) AS r2 FROM m a JOIN m b ON a.gen = b.gen AND b.snp > a.snp AND b.snp <= a.snp + 5 GROUP BY 1, 2", _MARK),
    "scan_ols_1df": _sql("SELECT snp, round(beta, 6) AS beta, round(chi2, 6) AS chi2 FROM t", _TEST),
    "lambda_gc": _sql(f"SELECT round(median(chi2) / {scans.MEDIAN_CHI2}e0, 6) AS lambda_gc FROM t", _TEST),
    "bonferroni_threshold": _sql("SELECT round(5e-2 / count(chi2), 10) AS threshold FROM t", _TEST),
    "topk_hits": _sql("SELECT snp, round(chi2, 6) AS chi2 FROM t ORDER BY t.chi2 DESC, snp LIMIT 10", _TEST),
    "per_locus_best": _sql("SELECT snp % 4 AS chr, round(max(chi2), 6) AS chi2, arg_max(snp, chi2) AS snp FROM t GROUP BY 1", _TEST),
    "chi2_histogram": _sql("SELECT CAST(floor(chi2 / 5e-1) AS BIGINT) AS bin, count(*) AS n FROM t GROUP BY 1", _TEST),
    "ar1_precision_quadratic_form": _sql(
        f"SELECT user_id AS series, count(*) AS n, round(CASE WHEN count(*) = 1 THEN sum(y * y) ELSE (sum(y * y) + {RHO}e0 * {RHO}e0 * sum(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN y * y ELSE 0 END) - {RHO}e0 * sum(coalesce(2 * y * p, 0))) / (1 - {RHO}e0 * {RHO}e0) END, 4) AS quad, round((count(*) - 1) * ln(1 - {RHO}e0 * {RHO}e0), 4) AS logdet FROM s GROUP BY 1",
        "s AS (SELECT user_id, value AS y, lag(value) OVER o AS p, lead(value) OVER o AS q FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))",
    ),
    "predict_marginal_means_equal": "SELECT level, round(avg(m), 4) AS mean FROM (SELECT l_returnflag AS level, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "predict_marginal_means_prop": "SELECT level, round(sum(m * w) / sum(w), 4) AS mean FROM (SELECT l_returnflag AS level, l_linenumber AS o, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_linenumber AS o, count(*) AS w FROM lineitem GROUP BY 1) USING (o) GROUP BY 1",
}
_TANH = "(exp(2 * ({0})) - 1) / (exp(2 * ({0})) + 1)"
_Z95 = "1.959963984540054e0"
_ANOVA = "an AS (SELECT msb, msw, n0, (msb - msw) / n0 AS v1, msw AS v2, 2 * msb * msb / (q - 1) AS vb, 2 * msw * msw / (obs - q) AS vw FROM (SELECT count(*) AS q, sum(n) AS obs, (sum(n * mean * mean) - sum(n * mean) ** 2 / sum(n)) / (count(*) - 1) AS msb, sum(ss) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM st))"
_POINTS = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}e0, {b}e0)" for k, (a, b) in enumerate(GRID)) + ") v(point, su2, se2))"
_ORACLES |= {
    "fisher_z_ci": _sql(
        f"SELECT l_returnflag, round(r, 6) AS r, n, round(z, 6) AS z_fisher, round(s, 6) AS se_z, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(hi - lo, 6) AS width, hi - lo <= 15e-1 AS informative FROM (SELECT *, {_TANH.format(f'z - {_Z95} * s')} AS lo, {_TANH.format(f'z + {_Z95} * s')} AS hi FROM c)",
        "c AS (SELECT *, 5e-1 * ln((1 + r) / (1 - r)) AS z, 1 / sqrt(n - 3) AS s FROM (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1))",
    ),
    "ratios_h2": _sql("SELECT 'price' AS target, component, round(v, 6) AS estimate, round(v / (v1 + v2), 6) AS share FROM (SELECT 'supplier' AS component, v1 AS v, v1, v2 FROM an UNION ALL SELECT 'residual', v2, v1, v2 FROM an)", _STATS, _ANOVA),
    "delta_method_ratio_se": _sql("SELECT round(v1 / (v1 + v2), 8) AS h2, round(sqrt(v2 * v2 * (vb + vw) / (n0 * n0) + v1 * v1 * vw + 2 * v1 * v2 * vw / n0) / (v1 + v2) ** 2, 8) AS se FROM an", _STATS, _ANOVA),
    "aic_grid_summary": _sql(
        "SELECT round(min(aic), 5) AS best_aic, arg_min(su2, aic) AS best_su2, arg_min(se2, aic) AS best_se2, count(*) FILTER (d <= 2) AS n_supported, count(*) AS n_cells, min(su2) FILTER (d <= 2) AS su2_min, max(su2) FILTER (d <= 2) AS su2_max, min(se2) FILTER (d <= 2) AS se2_min, max(se2) FILTER (d <= 2) AS se2_max, count(DISTINCT su2) * count(DISTINCT se2) - count(DISTINCT (su2, se2)) AS n_missing, count(*) - count(DISTINCT (su2, se2)) AS n_repeated FROM (SELECT *, aic - min(aic) OVER () AS d FROM p)",
        _STATS, _POINTS, f"p AS (SELECT su2, se2, 6 + {_NEG2} AS aic FROM st, g GROUP BY point, su2, se2)",
    ),
    "weighted_rows": "SELECT l_returnflag, count(*) AS n, round(sum(ln(w)), 4) AS log_w, round(sum(w), 4) AS w, round(sum(w * y), 4) AS wy, round(sum(w * y * y), 4) AS wyy FROM (SELECT l_returnflag, l_quantity AS w, ln(l_extendedprice) AS y FROM lineitem) WHERE w > 0 AND y IS NOT NULL GROUP BY 1",
    "fitted_residuals": _sql(
        "SELECT l_orderkey, l_linenumber, round(mu + u, 6) AS fitted, round(ln(l_extendedprice) - mu - u, 6) AS resid FROM lineitem JOIN b ON l_suppkey = level",
        _STATS, f"v AS (SELECT *, {_V} FROM st)", "mu AS (SELECT sum(n / (se2 + n * su2) * mean) / sum(n / (se2 + n * su2)) AS mu FROM v)", "b AS (SELECT level, mu, n * su2 / (se2 + n * su2) * (mean - mu) AS u FROM v, mu)",
    ),
    "posterior_rhat": _sql(
        "SELECT chains, round(n, 6) AS n, round(within, 6) AS within, round(between_, 6) AS between, round(sqrt(((n - 1) / n * within + between_) / within), 6) AS rhat FROM (SELECT count(*) AS chains, avg(k) AS n, avg(v) AS within, var_samp(m) AS between_ FROM (SELECT count(*) AS k, avg(value) AS m, var_samp(value) AS v FROM h GROUP BY chain, half))",
        "h AS (SELECT user_id AS chain, value, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= count(*) OVER (PARTITION BY user_id) // 2 THEN 0 ELSE 1 END AS half FROM events)",
    ),
    "spline_linear_basis": "SELECT knot, round(sum(v), 4) AS s, round(sum(v * v), 4) AS ss FROM (SELECT k AS knot, greatest(0, 1 - abs(l_quantity * 8 / 6e1 - k)) AS v FROM lineitem, range(9) r(k)) WHERE v <> 0 GROUP BY 1",
    "matern_half_pairs": _sql("SELECT src, dst, round(exp(-dist / 15e-1), 6) AS r FROM nb", _FIELD, _NEAR.format(k=1)),
    "spherical_corr_pairs": _sql("SELECT src, dst, round(CASE WHEN dist < 25e-1 THEN 1 - 15e-1 * dist / 25e-1 + 5e-1 * (dist / 25e-1) ** 3 ELSE 0 END, 6) AS r FROM nb", _FIELD, _NEAR.format(k=2)),
    "separable_cov_pairs": _sql(f"SELECT src, dst, round({RHO}e0 ** abs(a.r - b.r) * {PSI}e0 ** abs(a.c - b.c), 6) AS r FROM nb JOIN u a ON nb.src = a.id JOIN u b ON nb.dst = b.id", _FIELD, _NEAR.format(k=1)),
}
_ORACLES["ld_prune"] = "WITH RECURSIVE " + ", ".join([
    _MARK, "pl AS (SELECT snp, row_number() OVER (ORDER BY snp) AS place FROM m GROUP BY snp HAVING max(dose) > min(dose))",
    "r AS (SELECT a.snp AS a, b.snp AS b, corr(a.dose, b.dose) ** 2 AS r2 FROM m a JOIN m b ON a.gen = b.gen AND a.snp < b.snp GROUP BY 1, 2)",
    "nb AS (SELECT p.place, p.snp, coalesce(list(q.snp) FILTER (q.snp IS NOT NULL), []) AS near FROM pl p LEFT JOIN (SELECT q.snp, q.place, r.b FROM r JOIN pl q ON q.snp = r.a WHERE r2 >= 5e-2 - 1e-12) q ON q.b = p.snp AND p.place - q.place <= 5 GROUP BY 1, 2)",
    "st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS kept UNION ALL SELECT k + 1, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, snp) ELSE kept END FROM st JOIN nb ON place = k + 1)",
    "ke AS (SELECT unnest(kept) AS snp FROM (SELECT kept FROM st ORDER BY k DESC LIMIT 1))",
]) + " SELECT snp FROM ke WHERE snp NOT IN (SELECT b FROM r WHERE r2 > 1 - 1e-9 AND a IN (SELECT snp FROM ke) AND b IN (SELECT snp FROM ke))"
QUERIES = {k: globals()[k] for k in _ORACLES} | engine_queries.QUERIES
ORACLE_SQL = _ORACLES | engine_queries.ORACLE_SQL
