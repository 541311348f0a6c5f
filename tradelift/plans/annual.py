"""Annual plan queries."""

from pyspark.sql import functions as F

from tradelift.operators import annual as A, discount as D, fit as X, frame as M
from tradelift.plans.discount import BASIS, month_frame, r
from tradelift.plans.fixtures import txn
from tradelift.plans.models import FIXED
from tradelift.plans.registry import query, view
from tradelift.sources import ingest as I


def path(spark, sf, year=2000, grid=None):
    m, c = X.two_stage_model(month_frame(spark, sf), M.GROUP, FIXED)
    return A.default_path(m, c, M.GROUP, year, grid)


def plans(spark, sf):
    """One plan per outlet class: its scheme percentage of each calendar month, read as a sheet."""
    b = D.discount_basis(txn(spark, sf, *BASIS, "Final_Outlet_Classification"))
    sheet = b.groupBy(F.date_format("Date", "MMM").alias("Month")).pivot("Final_Outlet_Classification", ["OTHERGT", "SS", "WH"]).agg(
        F.concat(F.round(F.sum("scheme_amount") / F.sum("dsp_sales") * 150, 1).cast("string"), F.lit("%")))
    return I.read_plan_grid(sheet).select(F.col("scenario").alias("plan"), "plan_idx", "pct")


view("v_plans", """
SELECT "Final_Outlet_Classification" AS plan, CAST((month("Date") + 8) % 12 AS INTEGER) AS i, round(sum(scheme) / sum(dsp_amt) * 150, 1) AS pct FROM v_tb GROUP BY ALL
""")


def path_views(n, year):
    view(f"v_sp{n}", f"""
SELECT g.*, m.base_price AS bp, m.actual AS act, m.store_count, m.resid, m.base AS b0_, ly.base AS ly, pb.base AS before FROM (
  SELECT "Sizes", "Slab", i, CAST(DATE '{year}-04-01' + to_months(i) AS DATE) AS period, lastp FROM (SELECT "Sizes", "Slab", arg_max(base_price, period) AS lastp FROM v_model GROUP BY ALL),
    (SELECT unnest(range(12))::INTEGER AS i)) g
LEFT JOIN v_model m USING ("Sizes", "Slab", period)
LEFT JOIN v_model ly ON ly."Sizes" = g."Sizes" AND ly."Slab" = g."Slab" AND ly.period = g.period - INTERVAL 12 MONTH
LEFT JOIN v_model pb ON pb."Sizes" = g."Sizes" AND pb."Slab" = g."Slab" AND pb.period = DATE '{year}-03-01'
""")
    view(f"v_ob{n}", f"""
SELECT *, round_even(coalesce(last_value(b0_ IGNORE NULLS) OVER (PARTITION BY "Sizes", "Slab" ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   first_value(b0_ IGNORE NULLS) OVER (PARTITION BY "Sizes", "Slab" ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) / 0.5, 0) * 0.5 AS obs FROM v_sp{n}
""")
    view(f"v_path{n}", f"""
SELECT o."Sizes", o."Slab", o.i, o.period, f.intercept, f.b0, f.b1, f.b2, f.b3, coalesce(o.resid, coalesce(o.store_count, 0) - (s1.s1_icpt + s1.s1_slope * coalesce(act, obs))) AS resid, price, prev,
  round_even(least(greatest(CASE WHEN nly >= 12 THEN ly ELSE coalesce(lag(obs) OVER (PARTITION BY o."Sizes", o."Slab" ORDER BY i), prev) END, 0), 60) / 0.5, 0) * 0.5 AS dflt,
  round_even(round_even(lastp * 2, 0) / 2 * 0.5, 0) AS cogs
FROM (SELECT *, coalesce(bp, round_even(lastp * 2, 0) / 2) AS price, round_even(coalesce(before, first_value(obs) OVER w) / 0.5, 0) * 0.5 AS prev, count(ly) OVER (PARTITION BY "Sizes", "Slab") AS nly
      FROM v_ob{n} WINDOW w AS (PARTITION BY "Sizes", "Slab" ORDER BY i)) o
JOIN v_tac f ON o."Sizes" = f."Sizes" AND o."Slab" = f."Slab"
JOIN (SELECT DISTINCT "Sizes", "Slab", s1_icpt, s1_slope FROM v_model) s1 ON o."Sizes" = s1."Sizes" AND o."Slab" = s1."Slab"
""")
    view(f"v_pl{n}", f"""
SELECT *, greatest(intercept + b0 * resid + b1 * dflt + b3 * lag_d, 0) AS q_d, greatest(intercept + b0 * resid + b1 * pct_p + b3 * lag_p, 0) AS q_p,
  pp * (1 - dflt / 100) AS net_d, pp * (1 - pct_p / 100) AS net_p FROM (
  SELECT *, coalesce(lag(dflt) OVER w, prev) AS lag_d, coalesce(lag(pct_p) OVER w, prev) AS lag_p, round_even(price * 2, 0) / 2 AS pp FROM (
    SELECT p.*, s.plan, round_even(least(greatest(s.pct, 0), 60) / 0.5, 0) * 0.5 AS pct_p FROM v_path{n} p JOIN v_plans s USING (i))
  WINDOW w AS (PARTITION BY "Sizes", "Slab", plan ORDER BY i))
""")


path_views("a", 2000)
path_views("b", 2001)
K = ["Sizes", "Slab", "plan", "plan_idx"]
_ROWS = """SELECT "Sizes", "Slab", plan, i AS plan_idx, period, round(dflt, 2) AS default_pct, round(pct_p, 2) AS planned_pct, round(pp, 2) AS planned_price, round(q_d, 3) AS qty_default, round(q_p, 3) AS qty_planned,
  round(q_d * net_d, 2) AS revenue_default, round(q_p * net_p, 2) AS revenue_planned, round(q_p * (net_p - cogs), 2) AS profit_planned FROM v_pl{n}"""


def rows(d):
    return r(d.select(*K, "period", "default_pct", "planned_pct", "planned_price", "qty_default", "qty_planned", "revenue_default", "revenue_planned", "profit_planned"),
             2, qty_default=3, qty_planned=3)


@query("plan_spine", """SELECT "Sizes", "Slab", i AS plan_idx, period, round(bp, 4) AS base_price, round(resid, 4) AS residual_store, round(b0_, 4) AS base_discount_pct FROM v_spb""")
def _(spark, sf):
    m = X.stage1_residual(month_frame(spark, sf), M.GROUP)
    return r(A.plan_spine(m, M.GROUP, 2001).select("Sizes", "Slab", "plan_idx", "period", "base_price", "residual_store", "base_discount_pct"))


@query("grid_lookup", """
SELECT "Sizes", "Slab", i AS plan_idx, CASE "Sizes" WHEN '12-ML' THEN CASE "Slab" WHEN 'slab1' THEN CASE WHEN i IN (0, 5) THEN 18.0::DOUBLE WHEN i = 3 THEN 17 ELSE 14 END
   WHEN 'slab2' THEN CASE WHEN i IN (0, 5) THEN 24 WHEN i = 3 THEN 21 ELSE 17 END END
  ELSE CASE WHEN i IN (1, 5, 7) THEN CASE "Slab" WHEN 'slab1' THEN 13 WHEN 'slab2' THEN 17 ELSE 19 END ELSE CASE "Slab" WHEN 'slab1' THEN 12 WHEN 'slab2' THEN 15 ELSE 17 END END END AS grid_pct
FROM v_spa
""")
def _(spark, sf):
    m = X.stage1_residual(month_frame(spark, sf), M.GROUP)
    return A.grid_lookup(A.plan_spine(m, M.GROUP, 2000), A.default_grid(spark)).select("Sizes", "Slab", "plan_idx", "grid_pct")


@query("annual_plan", _ROWS.format(n="a"))
def _(spark, sf):
    return rows(A.annual_plan(path(spark, sf), plans(spark, sf), M.GROUP))


@query("annual_plan_forward", _ROWS.format(n="b"))
def _(spark, sf):
    return rows(A.annual_plan(path(spark, sf, 2001), plans(spark, sf), M.GROUP))


view("v_pe", """
SELECT "Sizes", "Slab", plan, world, coalesce(sum(CASE WHEN level > pl THEN (qn - qo) * pp * (1 - pl / 100) END), 0) AS inc, coalesce(sum(CASE WHEN level > pl THEN (qn - qo) * (pp * (1 - pl / 100) - cogs) END), 0) AS incp,
  coalesce(sum(CASE WHEN level > pl THEN pp * (level - pl) / 100 * qn END), 0) AS spend FROM (
  SELECT *, greatest(intercept + b0 * resid + b1 * pl + b3 * pl, 0) AS qo, greatest(intercept + b0 * resid + b1 * level + b3 * CASE WHEN hold = 1 THEN pl ELSE level END, 0) AS qn FROM (
    SELECT *, first_value(prevl) OVER h AS pl, row_number() OVER h AS hold FROM (
      SELECT *, sum(CASE WHEN abs(level - prevl) > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY "Sizes", "Slab", plan, world ORDER BY i) AS rid FROM (
        SELECT *, lag(level) OVER (PARTITION BY "Sizes", "Slab", plan, world ORDER BY i) AS prevl FROM (
          SELECT *, 'default' AS world, dflt AS level FROM v_pla UNION ALL SELECT *, 'planned', pct_p FROM v_pla)))
    WINDOW h AS (PARTITION BY "Sizes", "Slab", plan, world, rid ORDER BY i))) GROUP BY ALL
""")


@query("plan_episode_roi", """
SELECT "Sizes", "Slab", plan, world, round(inc, 2) AS incremental_revenue, round(incp, 2) AS incremental_profit, round(spend, 2) AS spend,
  round(coalesce(CASE WHEN spend > 1e-12 THEN inc / spend END, 0), 5) AS roi_x, round(coalesce(CASE WHEN spend > 1e-12 THEN incp / spend END, 0), 5) AS profit_roi_x FROM v_pe
""")
def _(spark, sf):
    p = A.annual_plan(path(spark, sf), plans(spark, sf), M.GROUP)
    return r(A.plan_episode_roi(p, M.GROUP), 2, roi_x=5, profit_roi_x=5)


view("v_pm", """
SELECT g.*, d.inc / nullif(d.spend, 0) AS rd, p.inc / nullif(p.spend, 0) AS rp, inv_p - inv_d AS dinv, CASE WHEN spend > 1e-12 THEN (rev_p - rev_d) / spend ELSE 0 END AS rr FROM (
  SELECT "Sizes", "Slab", plan, sum(q_d) AS q_d, sum(q_p) AS q_p, sum(q_d * net_d) AS rev_d, sum(q_p * net_p) AS rev_p, sum(q_d * (net_d - cogs)) AS prof_d, sum(q_p * (net_p - cogs)) AS prof_p,
    sum(pp * greatest(pct_p - dflt, 0) / 100 * q_p) AS spend, sum(pp * dflt / 100 * q_d) AS inv_d, sum(pp * pct_p / 100 * q_p) AS inv_p, avg(dflt) AS pd, avg(pct_p) AS ppc FROM v_pla GROUP BY ALL) g
JOIN (SELECT * FROM v_pe WHERE world = 'default') d USING ("Sizes", "Slab", plan) JOIN (SELECT * FROM v_pe WHERE world = 'planned') p USING ("Sizes", "Slab", plan)
""".replace("g.*, d.inc", "g.*, d.inc").replace("sum(pp * greatest(pct_p - dflt, 0) / 100 * q_p) AS spend", "sum(pp * greatest(pct_p - dflt, 0) / 100 * q_p) AS step_spend").replace(
    "CASE WHEN spend > 1e-12 THEN (rev_p - rev_d) / spend", "CASE WHEN step_spend > 1e-12 THEN (rev_p - rev_d) / step_spend"))


@query("plan_metrics", """
SELECT "Sizes", "Slab", plan, round((q_p - q_d) / q_d * 100, 5) AS volume_change_pct, round((rev_p - rev_d) / rev_d * 100, 5) AS revenue_change_pct, round((prof_p - prof_d) / prof_d * 100, 5) AS profit_change_pct,
  round((ppc - pd) / pd * 100, 5) AS promo_change_pct, round(step_spend, 2) AS total_spend_plan, round(dinv, 2) AS investment_change, round(rr, 5) AS roi_revenue_x, round(coalesce(rd, 0), 5) AS roi_default_x, round(coalesce(rp, 0), 5) AS roi_planned_x FROM v_pm
""")
def _(spark, sf):
    m = A.plan_metrics(A.annual_plan(path(spark, sf), plans(spark, sf), M.GROUP), M.GROUP)
    return r(m.select("Sizes", "Slab", "plan", "volume_change_pct", "revenue_change_pct", "profit_change_pct", "promo_change_pct", "total_spend_plan", "investment_change",
                      "roi_revenue_x", "roi_default_x", "roi_planned_x"), 5, total_spend_plan=2, investment_change=2)


@query("compare_plans", """
SELECT "Sizes", "Slab", plan, round(shown, 5) AS roi_planned_x, round(shown - coalesce(rd, 0), 5) AS roi_abs_change_x FROM (
  SELECT *, CASE WHEN abs(coalesce(rp, 0)) <= 1e-12 AND abs(rr) > 1e-12 AND abs(dinv) > 1e-12 THEN rr ELSE coalesce(rp, 0) END AS shown FROM v_pm)
""")
def _(spark, sf):
    m = A.plan_metrics(A.annual_plan(path(spark, sf), plans(spark, sf), M.GROUP), M.GROUP)
    return r(A.compare_plans(m).select("Sizes", "Slab", "plan", "roi_planned_x", "roi_abs_change_x"), 5)


@query("plan_changes", """
SELECT "Sizes", "Slab", plan, i AS plan_idx, round(pct_p - dflt, 3) AS discount_change_pp, round(pp - price, 3) AS price_change FROM v_pla WHERE abs(pct_p - dflt) > 1e-9 OR abs(pp - price) > 1e-9
""")
def _(spark, sf):
    p = A.annual_plan(path(spark, sf), plans(spark, sf), M.GROUP)
    return A.plan_changes(p).select(*K, "discount_change_pp", "price_change")
