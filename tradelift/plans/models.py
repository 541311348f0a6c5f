"""Model fitting queries. Oracles solve the same problems by coordinate descent in SQL."""

from pyspark.sql import functions as F

from tradelift.operators import fit as X, frame as M
from tradelift.plans.discount import month_frame, other_frame, r, total_days
from tradelift.plans.registry import query, view
from tradelift.schema import ModelParams

FIXED = ModelParams(optimize_l2=False, l2=0.1)


def descent_views(name, source, keys, y, feats, signs, lam="0.1", sweeps=1500, extra=""):
    """Oracle for the signed ridge: <name>_m standardised moments, <name>_w sweeps, <name> results."""
    p, k = len(feats), ", ".join(keys)
    s = [f"CASE WHEN stddev_pop({f}) <= 1e-12 THEN 1 ELSE stddev_pop({f}) END" for f in feats]
    cols = [f"avg({f}) AS mean{i}" for i, f in enumerate(feats)] + [f"{s[i]} AS sd{i}" for i in range(p)]
    cols += [f"covar_pop({y}, {f}) / ({s[i]}) AS c{i}" for i, f in enumerate(feats)]
    cols += [f"covar_pop({feats[i]}, {feats[j]}) / (({s[i]}) * ({s[j]})) AS k{i}_{j}" for i in range(p) for j in range(i, p)]
    base = f"SELECT {k}, count(*) AS n, avg({y}) AS ymean, var_pop({y}) AS yvar, {', '.join(cols)} FROM {source} GROUP BY {k}"
    view(name + "_m", f"SELECT *, {lam} AS lam_ FROM ({base}) {extra}")
    key = lambda i, j: f"k{min(i, j)}_{max(i, j)}"
    keyl = keys + (["lam_"] if extra else [])
    inner = f"SELECT m.*, w.it, {', '.join(f'w.w{i}' for i in range(p))} FROM {name}_w w JOIN {name}_m m USING ({', '.join(keyl)}) WHERE w.it < {sweeps}"
    for i in range(p):
        rest = " - ".join([f"c{i}"] + [f"{key(i, j)} * {'v' if j < i else 'w'}{j}" for j in range(p) if j != i])
        upd = f"({rest}) / ({key(i, i)} + lam_ + CASE WHEN {key(i, i)} + lam_ <= 1e-12 THEN 1 ELSE 0 END)"
        upd = f"greatest(0, {upd})" if signs[i] > 0 else f"least(0, {upd})" if signs[i] < 0 else upd
        inner = f"SELECT *, {upd} AS v{i} FROM ({inner})"
    lam_col = "lam_, " if extra else ""
    view(name + "_w", f"""SELECT {k}, {lam_col}0 AS it, {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(p))} FROM {name}_m
UNION ALL SELECT {k}, {lam_col}it + 1, {', '.join(f'v{i}' for i in range(p))} FROM ({inner})""")
    quad = " + ".join(f"{'' if i == j else '2 * '}{key(i, j)} * w{i} * w{j}" for i in range(p) for j in range(i, p))
    lin = " + ".join(f"c{i} * w{i}" for i in range(p))
    view(name, f"""SELECT *, ymean - ({' + '.join(f'b{i} * mean{i}' for i in range(p))}) AS intercept FROM (
SELECT {k}, m.lam_, n, ymean, {', '.join(f'w{i} / sd{i} AS b{i}, mean{i}' for i in range(p))}, 1 - (yvar - 2 * ({lin}) + {quad}) / yvar AS r2
FROM {name}_w JOIN {name}_m m USING ({', '.join(keyl)}) WHERE it = {sweeps})""")


G = ['"Sizes"', '"Slab"']
view("v_model", """
SELECT m.*, s1.slope AS s1_slope, s1.icpt AS s1_icpt, s1.r2 AS s1_r2, store_count - s1.icpt - s1.slope * actual AS resid FROM v_other m
JOIN (SELECT "Sizes", "Slab", regr_slope(store_count, actual) AS slope, regr_intercept(store_count, actual) AS icpt, regr_r2(store_count, actual) AS r2
      FROM v_other GROUP BY ALL) s1 USING ("Sizes", "Slab")
""")
CROSS = ["resid", "base", "lag1", "other"]
descent_views("v_fit", "v_model", G, "quantity", CROSS, [1, 1, -1, -1])
descent_views("v_ols", "v_model", G, "quantity", CROSS, [0, 0, 0, 0], lam="0.0", sweeps=4000)
descent_views("v_two", "v_model", G, "quantity", ["resid", "base"], [1, 1], lam="0.5", sweeps=400)
descent_views("v_tac", "v_model", G, "quantity", ["resid", "base", "tactical", "lag1"], [1, 1, 1, -1])


def cross_model(spark, sf, params=FIXED):
    return X.two_stage_cross_slab(other_frame(spark, sf), M.GROUP, params)


@query("stage1_residual", """SELECT "Sizes", "Slab", period, round(s1_icpt, 6) AS stage1_intercept, round(s1_slope, 6) AS stage1_coef_discount, round(s1_r2, 6) AS stage1_r2, round(resid, 6) AS residual_store FROM v_model""")
def _(spark, sf):
    s = X.stage1_residual(month_frame(spark, sf), M.GROUP)
    return r(s.select("Sizes", "Slab", "period", "stage1_intercept", "stage1_coef_discount", "stage1_r2", "residual_store"), 6)


@query("residual_map_join", """SELECT "Sizes", "Slab", period, round(resid, 6) AS observed_residual FROM v_model""")
def _(spark, sf):
    s = X.stage1_residual(month_frame(spark, sf), M.GROUP)
    j = X.residual_map_join(s, s.where(F.month("period") % 2 == 0), M.GROUP)
    return r(j.select("Sizes", "Slab", "period", "observed_residual"), 6)


@query("constrained_ridge", """SELECT "Sizes", "Slab", round(intercept, 4) AS intercept, round(b0, 4) AS coef_residual, round(b1, 4) AS coef_base, round(r2, 6) AS r2 FROM v_two""")
def _(spark, sf):
    s = X.stage1_residual(month_frame(spark, sf), M.GROUP)
    f = X.constrained_ridge(s, M.GROUP, "quantity", {"residual_store": 1, "base_discount_pct": 1}, 0.5)
    return r(
        f.select("Sizes", "Slab", "intercept", F.col("coef_residual_store").alias("coef_residual"), F.col("coef_base_discount_pct").alias("coef_base"), "r2"), 4, r2=6)


view("v_prefix", """
SELECT b."Sizes", b."Slab", b.rn AS t, a.resid, a.base, a.lag1, a.other, a.quantity
FROM (SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) AS rn FROM v_model) a
JOIN (SELECT "Sizes", "Slab", row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) AS rn FROM v_model) b
  ON a."Sizes" = b."Sizes" AND a."Slab" = b."Slab" AND a.rn < b.rn WHERE b.rn > 8
""")
descent_views("v_cv", "v_prefix", ['"Sizes"', '"Slab"', "t"], "quantity", CROSS, [1, 1, -1, -1], lam="lam", sweeps=250,
              extra="CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]::DOUBLE[]) AS lam)")
view("v_score", """
SELECT "Sizes", "Slab", c.lam_ AS lam, 1 - sum(power(m.quantity - (intercept + b0 * resid + b1 * base + b2 * lag1 + b3 * other), 2)) / (var_pop(m.quantity) * count(*)) AS cv_r2
FROM v_cv c JOIN (SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) AS t FROM v_model) m USING ("Sizes", "Slab", t) GROUP BY ALL
""")


@query("penalty_scores", """SELECT "Sizes", "Slab", lam, round(cv_r2, 6) AS cv_r2 FROM v_score""")
def _(spark, sf):
    s = X.cut(X.stage1_residual(other_frame(spark, sf), M.GROUP))
    return r(X.penalty_scores(s, M.GROUP, "period", "quantity", X.CROSS_SIGNS, ModelParams().candidates).drop("idx"), 6)


@query("tune_l2", """SELECT "Sizes", "Slab", lam, round(cv_r2, 6) AS cv_r2 FROM (SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY cv_r2 DESC, lam) AS k FROM v_score) WHERE k = 1""")
def _(spark, sf):
    s = X.cut(X.stage1_residual(other_frame(spark, sf), M.GROUP))
    return r(X.tune_l2(s, M.GROUP, "period", "quantity", X.CROSS_SIGNS), 6)


@query("two_stage_model", """
SELECT "Sizes", "Slab", period, round(pred, 3) AS predicted_quantity, round(bas, 3) AS baseline_quantity, round(spend, 2) AS spend,
  round(pred * base_price * (1 - actual / 100) - bas * base_price * (1 - base / 100), 2) AS incremental_revenue, round(r2, 6) AS r2 FROM (
  SELECT m.*, f.r2, intercept + b0 * resid + b1 * base + b2 * tactical + b3 * lag1 AS pred, intercept + b0 * resid + b1 * base + b3 * lag1 AS bas,
    base_price * tactical / 100 * (intercept + b0 * resid + b1 * base + b2 * tactical + b3 * lag1) AS spend FROM v_model m JOIN v_tac f USING ("Sizes", "Slab"))
""")
def _(spark, sf):
    m, _c = X.two_stage_model(month_frame(spark, sf), M.GROUP, FIXED)
    return r(m.select("Sizes", "Slab", "period", "predicted_quantity", "baseline_quantity", "spend", "incremental_revenue", "r2"), 3, spend=2, incremental_revenue=2, r2=6)


@query("two_stage_cross_slab", """
SELECT "Sizes", "Slab", m.period, round(intercept, 3) AS intercept, round(b0, 4) AS coef_residual_store, round(b1, 4) AS coef_base, round(b2, 4) AS coef_lag, round(b3, 4) AS coef_other, round(r2, 6) AS r2,
  round(intercept + b0 * resid + b1 * base + b2 * lag1 + b3 * other, 3) AS predicted_quantity, round(greatest(intercept + b0 * resid, 0), 3) AS non_discount_baseline_quantity
FROM v_model m JOIN v_fit f USING ("Sizes", "Slab")
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    return r(m.select("Sizes", "Slab", "period", "intercept", "coef_residual_store", F.col("coef_base_discount_pct").alias("coef_base"),
                      F.col("coef_lag1_base_discount_pct").alias("coef_lag"), F.col(f"coef_{X.OTHER}").alias("coef_other"), "r2",
                      "predicted_quantity", "non_discount_baseline_quantity"), 4, intercept=3, r2=6, predicted_quantity=3, non_discount_baseline_quantity=3)


view("v_best", """SELECT "Sizes", "Slab", lam, cv_r2 FROM (SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY cv_r2 DESC, lam) AS k FROM v_score) WHERE k = 1""")
descent_views("v_tuned", "v_model", G, "quantity", CROSS, [1, 1, -1, -1], lam="lam", extra='JOIN v_best USING ("Sizes", "Slab")')


@query("two_stage_tuned", """
SELECT "Sizes", "Slab", lam, round(cv_r2, 6) AS cv_r2, round(intercept, 3) AS intercept, round(b0, 4) AS coef_residual_store, round(b1, 4) AS coef_base, round(b2, 4) AS coef_lag, round(b3, 4) AS coef_other, round(r2, 6) AS r2
FROM v_tuned JOIN v_best USING ("Sizes", "Slab")
""")
def _(spark, sf):
    _m, c = X.two_stage_cross_slab(other_frame(spark, sf), M.GROUP)
    return r(c.select("Sizes", "Slab", "lam", "cv_r2", "intercept", "coef_residual_store", F.col("coef_base_discount_pct").alias("coef_base"),
                      F.col("coef_lag1_base_discount_pct").alias("coef_lag"), F.col(f"coef_{X.OTHER}").alias("coef_other"), "r2"), 4, cv_r2=6, intercept=3, r2=6)


@query("prefer_ols", """
SELECT "Sizes", "Slab", CASE WHEN o.b0 < 0 OR o.b1 < 0 OR o.b2 > 0 OR o.b3 > 0 THEN 'ridge' ELSE 'ols' END AS model,
  concat_ws(',', CASE WHEN o.b0 < 0 THEN 'residual_store' END, CASE WHEN o.b1 < 0 THEN 'base_discount_pct' END, CASE WHEN o.b2 > 0 THEN 'lag1_base_discount_pct' END,
    CASE WHEN o.b3 > 0 THEN 'other_slabs_weighted_base_discount_pct' END) AS violations,
  round(CASE WHEN o.b0 < 0 OR o.b1 < 0 OR o.b2 > 0 OR o.b3 > 0 THEN f.intercept ELSE o.intercept END, 3) AS used_intercept,
  round(CASE WHEN o.b0 < 0 OR o.b1 < 0 OR o.b2 > 0 OR o.b3 > 0 THEN f.b1 ELSE o.b1 END, 4) AS used_base
FROM v_fit f JOIN v_ols o USING ("Sizes", "Slab")
""")
def _(spark, sf):
    _m, c = cross_model(spark, sf)
    u = X.prefer_ols(c, X.CROSS_SIGNS)
    return r(u.select("Sizes", "Slab", "model", "violations", "used_intercept", F.col("used_coef_base_discount_pct").alias("used_base")), 4, used_intercept=3)


@query("predict_quantity", """
SELECT "Sizes", "Slab", period, round(greatest(intercept + b0 * resid + b1 * 15 + b2 * lag1, 0), 3) AS quantity_at_15 FROM v_model JOIN v_fit USING ("Sizes", "Slab")
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    q = X.predict_quantity(X.CROSS_SIGNS, {"residual_store": F.col("residual_store"), "base_discount_pct": F.lit(15.0),
                                           "lag1_base_discount_pct": F.col("lag1_base_discount_pct")})
    return r(m.select("Sizes", "Slab", "period", F.greatest(q, F.lit(0.0)).alias("quantity_at_15")), 3)


view("v_size", """
SELECT s.*, coalesce(lag(base) OVER (PARTITION BY "Sizes" ORDER BY period), base) AS lag1, greatest(actual - base, 0) AS tactical FROM (
  SELECT "Sizes", "Month" AS period, count(DISTINCT "Outlet_ID") AS stores, sum("Quantity") AS quantity, sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100 AS actual,
    sum("SalesValue_atBasicRate") / sum("Quantity") AS base_price, sum("MRP" * "Quantity") / sum("Quantity") AS mrp, any_value(base) AS base
  FROM v_defined d JOIN (SELECT "Sizes", period, sum(fixed_weight * base) AS base FROM v_btab GROUP BY ALL) b ON d."Sizes" = b."Sizes" AND d."Month" = b.period
  WHERE "Slab" <> 'slab0' GROUP BY d."Sizes", "Month") s
""".replace('SELECT "Sizes", "Month" AS period, count', 'SELECT d."Sizes", "Month" AS period, count').replace('any_value(base) AS base', 'any_value(b.base) AS base'))
view("v_sizem", """
SELECT m.*, stores - icpt - slope * actual AS resid FROM v_size m JOIN (
  SELECT "Sizes", regr_slope(stores, actual) AS slope, regr_intercept(stores, actual) AS icpt FROM v_size GROUP BY 1) USING ("Sizes")
""")
descent_views("v_sfit", "v_sizem", ['"Sizes"'], "quantity", ["resid", "base", "tactical", "lag1"], [1, 1, 1, -1])
view("v_pair", """
SELECT 1 AS one, a.period, a.quantity * 12 + b.quantity * 18 AS ml, a.resid AS r12, b.resid AS r18, a.base AS b12, b.base AS b18, a.lag1 AS l12, b.lag1 AS l18, a.mrp AS p12, b.mrp AS p18
FROM v_sizem a JOIN v_sizem b USING (period) WHERE a."Sizes" = '12-ML' AND b."Sizes" = '18-ML'
""")
descent_views("v_pfit", "v_pair", ["one"], "ml", ["r12", "r18", "b12", "b18", "l12", "l18", "p12", "p18"], [1, 1, 1, 1, -1, -1, -1, -1], sweeps=3000)


@query("size_level_model", """
SELECT "Sizes", m.period, round(intercept + b0 * resid + b1 * base + b2 * tactical + b3 * lag1, 3) AS predicted_quantity, round(r2, 6) AS r2 FROM v_sizem m JOIN v_sfit USING ("Sizes")
""")
def _(spark, sf):
    frame = M.size_month_frame(total_days(spark, sf))
    m, _c = X.two_stage_model(frame, ["Sizes"], FIXED)
    return r(m.select("Sizes", "period", "predicted_quantity", "r2"), 3, r2=6)


@query("two_pack_model", """
SELECT m.period, round(ml, 2) AS combined_volume_ml, round(intercept + b0*r12 + b1*r18 + b2*b12 + b3*b18 + b4*l12 + b5*l18 + b6*p12 + b7*p18, 2) AS predicted_volume_ml,
  round(greatest(intercept + b0*r12 + b1*r18 + b6*p12 + b7*p18, 0), 2) AS non_discount_baseline_ml, round(r2, 6) AS r2 FROM v_pair m JOIN v_pfit USING (one)
""")
def _(spark, sf):
    m, _c = X.two_pack_model(M.size_month_frame(total_days(spark, sf)))
    return r(m.select("period", "combined_volume_ml", "predicted_volume_ml", "non_discount_baseline_ml", "r2"), 2, r2=6)


_PACK = list(zip(X.TWO_PACK_SIGNS.items(), range(8)))


@query("two_pack_coefficients", f"""
SELECT {", ".join(f"round(any_value(b{i}), 3) AS coef_{x}, '{'>=0' if s > 0 else '<=0'}' AS constraint_{x}" for (x, s), i in _PACK)},
  count(*) FILTER (WHERE intercept + b0*r12 + b1*r18 + b6*p12 + b7*p18 <= 0) AS baseline_zero_clip_months,
  round(count(*) FILTER (WHERE intercept + b0*r12 + b1*r18 + b6*p12 + b7*p18 <= 0) * 100.0 / count(*), 6) AS baseline_zero_clip_pct
FROM v_pair m JOIN v_pfit USING (one)
""")
def _(spark, sf):
    _m, coefs = X.two_pack_model(M.size_month_frame(total_days(spark, sf)))
    names = [x for x in X.TWO_PACK_SIGNS]
    return coefs.select(*[F.round(f"coef_{x}", 3).alias(f"coef_{x}") for x in names], *[f"constraint_{x}" for x in names],
                        "baseline_zero_clip_months", F.round("baseline_zero_clip_pct", 6).alias("baseline_zero_clip_pct"))


@query("pair_sizes", """
SELECT a.period, round(a.quantity, 4) AS quantity_12, round(b.quantity, 4) AS quantity_18 FROM v_size a JOIN v_size b USING (period) WHERE a."Sizes" = '12-ML' AND b."Sizes" = '18-ML'
""")
def _(spark, sf):
    return r(X.pair_sizes(M.month_totals(total_days(spark, sf), ["Sizes"], "TotalDiscount", "SalesValue_atBasicRate"), ["quantity"]))


_OLS = """
SELECT *, CASE WHEN se_slope > 0 THEN slope / se_slope END AS t_slope, CASE WHEN se_intercept > 0 THEN intercept / se_intercept END AS t_intercept FROM (
SELECT *, sqrt(mse) AS se, sqrt(mse / (n * vx)) AS se_slope, sqrt(mse / n * (1 + xm * xm / vx)) AS se_intercept, 1 - (1 - r_squared) * (n - 1) / (n - 2) AS adj_r_squared,
  r_squared / ((1 - r_squared) / (n - 2)) AS f_stat FROM (
SELECT "Sizes", "Slab", count(*) AS n, regr_slope(quantity, actual) AS slope, regr_intercept(quantity, actual) AS intercept, regr_r2(quantity, actual) AS r_squared,
  avg(actual) AS xm, var_pop(actual) AS vx, count(*) * var_pop(quantity) * (1 - regr_r2(quantity, actual)) / (count(*) - 2) AS mse FROM v_month GROUP BY ALL))
"""


@query("ols_inference", "SELECT \"Sizes\", \"Slab\", n, " + ", ".join(
    f"round({c}, 5) AS {c}" for c in ("intercept", "slope", "r_squared", "adj_r_squared", "se", "se_intercept", "se_slope", "t_intercept", "t_slope", "f_stat")) + f" FROM ({_OLS})")
def _(spark, sf):
    return r(X.ols_inference(month_frame(spark, sf), M.GROUP, "actual_discount_pct", "quantity"), 5)


@query("ols_p_values")
def _(spark, sf):
    return r(X.ols_p_values(X.ols_inference(month_frame(spark, sf), M.GROUP, "actual_discount_pct", "quantity")), 6)
