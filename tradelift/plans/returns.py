"""ROI, elasticity and forecast queries."""

from pyspark.sql import functions as F

from tradelift.operators import fit as X, forecast as O, frame as M, roi as R, sequence as Q
from tradelift.plans.discount import defined_days, month_frame, r
from tradelift.plans.models import FIXED, cross_model
from tradelift.plans.registry import query, view
from tradelift.schema import ModelParams

COEFS = list(X.CROSS_SIGNS)


def holds(spark, sf):
    m, _c = cross_model(spark, sf)
    return m, R.hold_months(m, M.GROUP, COEFS, R.resolve_cogs("Sizes", FIXED))


view("v_hold", """
SELECT *, greatest(intercept + b0 * resid + b1 * prevl + b2 * prevl, 0) AS q_old, greatest(intercept + b0 * resid + b1 * level + b2 * lagn, 0) AS q_new,
       CASE "Sizes" WHEN '12-ML' THEN 6.0 ELSE 8.0 END AS cogs FROM (
  SELECT g.*, m.resid, f.intercept, f.b0, f.b1, f.b2, f.r2, CASE WHEN hold = 1 THEN prevl ELSE level END AS lagn FROM (
    SELECT *, first_value(prev) OVER (PARTITION BY "Sizes", "Slab", regime_id ORDER BY period) AS prevl FROM v_regime) g
  JOIN v_model m USING ("Sizes", "Slab", period) JOIN v_fit f USING ("Sizes", "Slab") WHERE level > prevl)
""")
view("v_epi", """
SELECT "Sizes", "Slab", regime_id, min(period) AS start_period, max(period) AS end_period, count(*) AS hold_months, min(prevl) AS prev_base, min(level) AS new_base,
  sum(base_price * (level - prevl) / 100 * q_new) AS spend, sum((q_new - q_old) * base_price * (1 - prevl / 100)) AS inc,
  sum((q_new - q_old) * (base_price * (1 - prevl / 100) - cogs)) AS incp FROM v_hold GROUP BY ALL
""")


@query("structural_roi", """
SELECT "Sizes", "Slab", start_period, end_period, hold_months, prev_base, new_base, round(spend, 2) AS spend, round(inc, 2) AS incremental_revenue, round(incp, 2) AS incremental_profit,
  round(inc / spend, 5) AS roi_1mo, round(incp / spend, 5) AS profit_roi_1mo FROM v_epi
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    e = R.structural_roi(m, M.GROUP, COEFS, R.resolve_cogs("Sizes", FIXED), FIXED)
    return r(e.select("Sizes", "Slab", "start_period", "end_period", "hold_months", "prev_base", "new_base", "spend", "incremental_revenue",
                      "incremental_profit", "roi_1mo", "profit_roi_1mo"), 2, roi_1mo=5, profit_roi_1mo=5)


_SUM = """SELECT "Sizes", "Slab", count(*) AS episodes, avg(inc / spend) AS avg_roi_1mo, avg(incp / spend) AS avg_profit_roi_1mo, sum(spend) AS total_spend,
  sum(inc) AS total_incremental_revenue, sum(incp) AS total_incremental_profit FROM v_epi GROUP BY ALL"""


@query("roi_summary", f"""
SELECT "Sizes", "Slab", episodes, round(avg_roi_1mo, 5) AS avg_roi_1mo, round(avg_profit_roi_1mo, 5) AS avg_profit_roi_1mo, round(total_spend, 2) AS total_spend,
  round(total_incremental_revenue, 2) AS total_incremental_revenue, round(total_incremental_profit, 2) AS total_incremental_profit,
  round(total_incremental_revenue / total_spend, 5) AS structural_roi_1mo, round(total_incremental_profit / total_spend, 5) AS structural_profit_roi_1mo FROM ({_SUM})
""")
def _(spark, sf):
    _m, h = holds(spark, sf)
    s = R.roi_summary(R.structural_episodes(h, M.GROUP), M.GROUP)
    return r(s, 5, total_spend=2, total_incremental_revenue=2, total_incremental_profit=2)


@query("combined_roi", f"""
SELECT coalesce("Sizes", 'TOTAL') AS "Sizes", count(*) AS slabs, round(coalesce(sum(total_spend), 0), 2) AS total_spend, round(coalesce(sum(total_incremental_revenue), 0), 2) AS total_incremental_revenue,
  round(coalesce(sum(total_incremental_profit), 0), 2) AS total_incremental_profit, round(coalesce(sum(total_incremental_revenue) / sum(total_spend), 0), 5) AS combined_roi_1mo,
  round(coalesce(sum(total_incremental_profit) / sum(total_spend), 0), 5) AS combined_profit_roi_1mo, round(sum(quantity * r2) / sum(quantity), 6) AS weighted_r2
FROM (SELECT "Sizes", "Slab", sum(quantity) AS quantity, any_value(f.r2) AS r2 FROM v_model JOIN v_fit f USING ("Sizes", "Slab") GROUP BY ALL)
LEFT JOIN ({_SUM}) USING ("Sizes", "Slab") GROUP BY GROUPING SETS (("Sizes"), ())
""")
def _(spark, sf):
    m, h = holds(spark, sf)
    quality = m.groupBy(*M.GROUP).agg(F.sum("quantity").alias("quantity"), F.first("r2").alias("r2"))
    c = R.combined_roi(R.roi_summary(R.structural_episodes(h, M.GROUP), M.GROUP), quality)
    return r(c, 2, combined_roi_1mo=5, combined_profit_roi_1mo=5, weighted_r2=6)


view("v_tact", """
SELECT m.*, p.pred, p.bas, base_price * tactical / 100 * pred AS spend, pred * base_price * (1 - actual / 100) AS rev, bas * base_price * (1 - base / 100) AS brev
FROM v_model m JOIN (SELECT "Sizes", "Slab", period, intercept + b0 * resid + b1 * base + b2 * tactical + b3 * lag1 AS pred, intercept + b0 * resid + b1 * base + b3 * lag1 AS bas
  FROM v_model JOIN v_tac USING ("Sizes", "Slab")) p USING ("Sizes", "Slab", period)
""")


@query("tactical_roi", """
SELECT "Sizes", "Slab", period, round(spend, 2) AS spend, round(rev - brev, 2) AS incremental_revenue, round((pred / bas - 1) * 100, 5) AS qty_lift_pct,
  round(((1 - base / 100) / (1 - actual / 100) - 1) * 100, 5) AS breakeven_qty_lift_pct, round((rev - brev) / spend, 4) AS roi_1mo FROM v_tact WHERE tactical > 0.5
""")
def _(spark, sf):
    m, _c = X.two_stage_model(month_frame(spark, sf), M.GROUP, FIXED)
    t = R.tactical_roi(m, M.GROUP)
    return r(t.select("Sizes", "Slab", "period", "spend", "incremental_revenue", "qty_lift_pct", "breakeven_qty_lift_pct", "roi_1mo"), 5, spend=2, incremental_revenue=2, roi_1mo=4)


@query("lead_two_period", """
SELECT "Sizes", "Slab", period, round(two, 2) AS incremental_revenue_2mo, round(two / nullif(spend, 0), 4) AS roi_2mo FROM (
  SELECT *, rev + coalesce(lead(rev) OVER w, 0) - brev - coalesce(lead(brev) OVER w, 0) AS two FROM v_tact WINDOW w AS (PARTITION BY "Sizes", "Slab" ORDER BY period))
""")
def _(spark, sf):
    m, _c = X.two_stage_model(month_frame(spark, sf), M.GROUP, FIXED)
    d = Q.lead_two_period(m, M.GROUP, "period")
    return r(d.select("Sizes", "Slab", "period", "incremental_revenue_2mo", "roi_2mo"), 2, roi_2mo=4)


@query("resolve_cogs", """
SELECT "Sizes", "Slab", CASE "Sizes" WHEN '12-ML' THEN 9.5::DOUBLE ELSE 8.0::DOUBLE END AS mapped, CASE "Sizes" WHEN '12-ML' THEN 6.0::DOUBLE ELSE 8.0::DOUBLE END AS own_default,
  round_even(arg_min(base_price, period) * 0.5, 0) AS half_first_price FROM v_month GROUP BY ALL
""")
def _(spark, sf):
    m = month_frame(spark, sf).withColumn("half", R.default_cogs(None, M.GROUP))
    mapped = ModelParams(cogs_per_size={"12 ml".replace(" ", "-"): 9.5, "18-ML": 0.0})
    return m.select("Sizes", "Slab", R.resolve_cogs("Sizes", mapped).alias("mapped"), R.resolve_cogs("Sizes").alias("own_default"),
                    R.resolve_cogs(F.lit("24-ML"), ModelParams(), F.col("half")).alias("half_first_price")).distinct()


@query("profit_roi", """
SELECT "Sizes", "Slab", period, round((q_new - q_old) * (base_price * (1 - prevl / 100) - 7.5), 2) AS incremental_profit,
  round((q_new - q_old) * (base_price * (1 - prevl / 100) - 7.5) / (base_price * (level - prevl) / 100 * q_new), 5) AS profit_roi FROM v_hold
""")
def _(spark, sf):
    _m, h = holds(spark, sf)
    return r(R.profit_roi(h, F.lit(7.5)).select("Sizes", "Slab", "period", "incremental_profit", "profit_roi"), 2, profit_roi=5)


@query("roi_by_month", """
SELECT "Sizes", "Slab", period, round(inc / spend, 5) AS roi_1mo FROM v_hold JOIN v_epi USING ("Sizes", "Slab", regime_id)
""")
def _(spark, sf):
    _m, h = holds(spark, sf)
    return r(R.roi_by_month(h, M.GROUP), 5)


@query("episode_breakdown", """
SELECT "Sizes", "Slab", period, round(b0 * resid, 3) AS part_residual, round(b1 * prevl, 3) AS part_base_old, round(b1 * level, 3) AS part_base_new, round(b2 * prevl, 3) AS part_lag_old,
  round(b2 * lagn, 3) AS part_lag_new, round(base_price * (1 - level / 100), 3) AS new_price, round(q_old, 3) AS qty_old, round(q_new, 3) AS qty_new FROM v_hold
""")
def _(spark, sf):
    _m, h = holds(spark, sf)
    return r(R.episode_breakdown(h).select("Sizes", "Slab", "period", "part_residual", "part_base_old", "part_base_new", "part_lag_old", "part_lag_new", "new_price", "qty_old", "qty_new"), 3)


@query("roi_timeline", """
SELECT "Sizes", "Slab", m.period, round(quantity, 2) AS quantity, round(inc / spend, 5) AS episode_roi_1mo, round(spend, 2) AS episode_spend
FROM v_model m LEFT JOIN (SELECT *, start_period AS period FROM v_epi) e USING ("Sizes", "Slab", period)
""")
def _(spark, sf):
    m, h = holds(spark, sf)
    t = R.roi_timeline(m, R.structural_episodes(h, M.GROUP), M.GROUP)
    return r(t.select("Sizes", "Slab", "period", "quantity", "episode_roi_1mo", "episode_spend"), 2, episode_roi_1mo=5)


view("v_sizeq", """SELECT "Sizes", "Month" AS period, sum("Quantity") AS q FROM v_defined WHERE "Slab" <> 'slab0' GROUP BY ALL""")
view("v_ela", """
SELECT count(*) AS months, regr_slope(c12, c18) AS e12, regr_slope(c18, c12) AS e18, regr_r2(c12, c18) AS r2_12, regr_r2(c18, c12) AS r2_18 FROM (
  SELECT (a.q / lag(a.q) OVER (ORDER BY period) - 1) * 100 AS c12, (b.q / lag(b.q) OVER (ORDER BY period) - 1) * 100 AS c18
  FROM v_sizeq a JOIN v_sizeq b USING (period) WHERE a."Sizes" = '12-ML' AND b."Sizes" = '18-ML') WHERE c12 IS NOT NULL
""")


def size_months(spark, sf):
    return M.month_totals(defined_days(spark, sf), ["Sizes"])


@query("cross_elasticity", """SELECT months, round(e12, 6) AS elasticity_12_from_18, round(e18, 6) AS elasticity_18_from_12, round(r2_12, 6) AS r2_12, round(r2_18, 6) AS r2_18 FROM v_ela""")
def _(spark, sf):
    return r(O.cross_elasticity(size_months(spark, sf)), 6)


@query("trend_forecast", """
SELECT "Sizes", CAST(step AS INTEGER) AS step, CAST(last + to_months(step) AS DATE) AS period, round(greatest(icpt + slope * (n - 1 + step), 0), 3) AS quantity FROM (
  SELECT "Sizes", count(*) AS n, max(period) AS last, regr_slope(q, i) AS slope, regr_intercept(q, i) AS icpt FROM (
    SELECT *, row_number() OVER (PARTITION BY "Sizes" ORDER BY period) - 1 AS i FROM v_sizeq) GROUP BY 1), (SELECT unnest([1, 2, 3])::INTEGER AS step)
""")
def _(spark, sf):
    return r(O.trend_forecast(size_months(spark, sf), ["Sizes"], "period", "quantity", 3), 3)


@query("holt_forecast")
def _(spark, sf):
    return r(O.holt_forecast(size_months(spark, sf), ["Sizes"], "period", "quantity", 3), 3)


@query("month_spine", """
SELECT s."Sizes", m.period, s."Slab", round(coalesce(quantity, 0), 4) AS quantity FROM (SELECT DISTINCT period FROM v_month) m CROSS JOIN (SELECT DISTINCT "Sizes", "Slab" FROM v_month) s
LEFT JOIN (SELECT "Sizes", "Slab", period, quantity FROM v_month) q ON m.period = q.period AND s."Sizes" = q."Sizes" AND s."Slab" = q."Slab"
""")
def _(spark, sf):
    return r(O.month_spine(M.month_totals(defined_days(spark, sf)), ["Sizes", "Slab"], ["quantity"]))


view("v_hist", """
SELECT m."Sizes", period, sum(greatest(intercept + b0 * resid, 0)) AS baseline, sum(b1 * base + b2 * lag1 + b3 * other) AS component
FROM v_model m JOIN v_fit USING ("Sizes", "Slab") GROUP BY ALL
""")
view("v_fc", """
SELECT "Sizes", period, baseline, component, FALSE AS is_forecast FROM v_hist
UNION ALL
SELECT "Sizes", CAST(last + to_months(step) AS DATE), greatest(icpt + slope * (n - 1 + step), 0), component, TRUE FROM (
  SELECT "Sizes", count(*) AS n, max(period) AS last, regr_slope(baseline, i) AS slope, regr_intercept(baseline, i) AS icpt FROM (
    SELECT *, row_number() OVER (PARTITION BY "Sizes" ORDER BY period) - 1 AS i FROM v_hist) GROUP BY 1)
JOIN (SELECT "Sizes", component, CAST(4 - row_number() OVER (PARTITION BY "Sizes" ORDER BY period DESC) AS INTEGER) AS step FROM v_hist QUALIFY step >= 1) USING ("Sizes")
""")


@query("baseline_forecast", """
SELECT "Sizes", period, round(baseline, 3) AS baseline_quantity, round(component, 3) AS discount_component, is_forecast, round(sum(baseline) OVER (PARTITION BY period), 3) AS total_baseline FROM v_fc
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    return r(O.baseline_forecast(m, 3), 3)


@query("baseline_decomposition", """
SELECT "Sizes", period, round(q, 3) AS total_volume, round(least(greatest(baseline, 0), q), 3) AS baseline_volume, round(greatest(q - least(greatest(baseline, 0), q), 0), 3) AS discount_volume
FROM v_hist JOIN v_sizeq USING ("Sizes", period)
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    actual = m.groupBy("Sizes", "period").agg(F.sum("quantity").alias("volume"))
    return r(O.baseline_decomposition(O.pack_history(m), actual), 3)


@query("slab_baseline_projection", """
SELECT period, coalesce("Sizes", 'TOTAL') AS "Sizes", coalesce("Slab", 'ALL') AS "Slab", round(sum(greatest(intercept + b0 * resid, 0)), 3) AS baseline_quantity
FROM v_model JOIN v_fit USING ("Sizes", "Slab") GROUP BY GROUPING SETS ((period, "Sizes", "Slab"), (period, "Sizes"), (period))
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    return r(O.slab_baseline_projection(m), 3)


@query("cross_adjusted_forecast", """
SELECT period, is_forecast, round(b12, 3) AS baseline_quantity_12, round(b18, 3) AS baseline_quantity_18,
  round(CASE WHEN is_forecast THEN greatest(b12 * (1 + e12 * ch18 / 100), 0) ELSE b12 END, 3) AS baseline_12_adjusted,
  round(CASE WHEN is_forecast THEN greatest(b18 * (1 + e18 * ch12 / 100), 0) ELSE b18 END, 3) AS baseline_18_adjusted
FROM (SELECT period, a.is_forecast, a.baseline AS b12, b.baseline AS b18, coalesce((a.baseline / nullif(lag(a.baseline) OVER (ORDER BY period), 0) - 1) * 100, 0) AS ch12,
        coalesce((b.baseline / nullif(lag(b.baseline) OVER (ORDER BY period), 0) - 1) * 100, 0) AS ch18
      FROM v_fc a JOIN v_fc b USING (period) WHERE a."Sizes" = '12-ML' AND b."Sizes" = '18-ML'), v_ela
""")
def _(spark, sf):
    m, _c = cross_model(spark, sf)
    f = O.cross_adjusted_forecast(O.baseline_forecast(m, 3), O.cross_elasticity(m.groupBy("Sizes", "period").agg(F.sum("quantity").alias("quantity"))))
    return r(f.select("period", "is_forecast", "baseline_quantity_12", "baseline_quantity_18", "baseline_12_adjusted", "baseline_18_adjusted"), 3)
