"""Scenario queries. The scenario set is the five ladders history offers, so it follows the data."""

from pyspark.sql import Window, functions as F

from tradelift.operators import discount as D, families as FM, forecast as O, frame as M, ladder as L, roi as R, scenario as C, sequence as Q, scope as S
from tradelift.plans.discount import BASIS, defined_days, month_frame, r
from tradelift.plans.fixtures import txn
from tradelift.plans.models import FIXED, cross_model
from tradelift.plans.registry import query, view
from tradelift.plans.scope import RULES
from tradelift.functions import columns as K
from tradelift.functions.lineage import cut


class Base:
    """The shared inputs of one scenario query, each small and cut from the fact's lineage once."""

    def __init__(self, spark, sf):
        self.model, _c = cross_model(spark, sf)
        days = self.model.groupBy("Sizes", "Slab", F.col("period").alias("Date")).agg(F.sum("quantity").alias("Quantity"))
        self.cells = cut(C.plan_cells(self.model, M.slab_weights(days), R.resolve_cogs("Sizes", FIXED)))
        self.history = L.history_ladders(self.model)
        first = self.cells.agg(F.min("period")).scalar()
        self.anchors = L.pick_ladders(self.history, first)
        basis = S.outlet_days(D.discount_basis(txn(spark, sf, *BASIS)), RULES).where(K.allowed_slab("Slab"))
        self.reference = C.reference_totals(basis, self.cells, R.resolve_cogs("Sizes", FIXED))
        self.elasticity = O.cross_elasticity(self.model.groupBy("Sizes", "period").agg(F.sum("quantity").alias("quantity")))

    def values(self):
        return self.anchors.select("scenario_id", "period", "Sizes", "Slab", "value")

    def scored(self, mode="additive"):
        return C.score_scenarios(self.cells, self.values(), self.reference, elasticity=self.elasticity, mode=mode)

    def metrics(self):
        return C.scenario_metrics(C.scenario_summary(self.scored(), self.reference))


view("v_cells", """
SELECT c.*, greatest(intercept + b0 * resid_ahead, 0) AS baseline, CASE WHEN idx > 0 THEN dflt ELSE dlast END AS dlag,
  coalesce((SELECT sum(w.weight * x.base) / sum(w.weight) FROM v_trail x JOIN v_weights w USING ("Sizes", "Slab") WHERE x."Sizes" = c."Sizes" AND x."Slab" <> c."Slab" AND x.idx = c.idx), 0) AS odflt
FROM (
  SELECT t."Sizes", t."Slab", t.idx, CAST(e.fin + to_months(t.idx + 1) AS DATE) AS period, t.base AS dflt, l.dlast, l.quantity, greatest(l.quantity, 1) AS anchor, l.resid, l.lastlag, l.base_price AS dsp, l.clp,
    CASE t."Sizes" WHEN '12-ML' THEN 6.0 ELSE 8.0 END AS cogs, f.intercept, f.b0, f.b1, f.b2, f.b3, w.weight, g.icpt + g.slope * (g.n + t.idx) AS resid_ahead
  FROM v_trail t JOIN v_lastrow l USING ("Sizes", "Slab") JOIN v_fit f USING ("Sizes", "Slab") JOIN v_weights w USING ("Sizes", "Slab")
  JOIN (SELECT "Sizes", "Slab", count(*) AS n, regr_slope(resid, i) AS slope, regr_intercept(resid, i) AS icpt FROM (
    SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) - 1 AS i FROM v_model) GROUP BY ALL) g USING ("Sizes", "Slab"), (SELECT max(period) AS fin FROM v_model) e) c
""")
view("v_trail", """SELECT "Sizes", "Slab", CAST(3 - row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period DESC) AS INTEGER) AS idx, base FROM v_month QUALIFY idx >= 0""")
view("v_lastrow", """
SELECT m."Sizes", m."Slab", arg_max(m.base, m.period) AS dlast, arg_max(m.quantity, m.period) AS quantity, arg_max(m.resid, m.period) AS resid, arg_max(m.lag1, m.period) AS lastlag,
  arg_max(m.base_price, m.period) AS base_price, arg_max(c.clp / m.quantity, m.period) AS clp
FROM v_model m JOIN (SELECT "Sizes", "Slab", "Month" AS period, sum(clp_amt) AS clp FROM v_db GROUP BY ALL) c USING ("Sizes", "Slab", period) GROUP BY ALL
""")
view("v_lad", """
SELECT "Sizes", "Slab", period, round(base, 2) AS v, count(*) OVER (PARTITION BY "Sizes", period) = CASE "Sizes" WHEN '12-ML' THEN 2 ELSE 4 END AS is_full,
  avg(round(base, 2)) OVER (PARTITION BY "Sizes", period) AS a, string_agg(printf('%.2f', round(base, 2)), '|') OVER (PARTITION BY "Sizes", period ORDER BY "Slab" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sig
FROM v_month
""")
view("v_src", """
SELECT k.*, i.idx, i.period FROM (
  SELECT "Sizes", max(period) AS latest, arg_max(period, (a, period)) AS deep, arg_max(period, (-a, period)) AS shallow, any_value(common) AS common
  FROM v_lad JOIN (SELECT "Sizes", arg_max(period, (n, period)) AS common FROM (SELECT "Sizes", sig, count(*) AS n, max(period) AS period FROM (SELECT DISTINCT "Sizes", sig, period FROM v_lad WHERE is_full) GROUP BY ALL) GROUP BY 1) USING ("Sizes")
  WHERE is_full GROUP BY 1) k, (SELECT DISTINCT idx, period FROM v_cells) i
""")
view("v_anch", """
SELECT s.scenario_id, s.idx, s.period, s."Sizes", l."Slab", l.v AS value FROM (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM v_lad z WHERE z."Sizes" = q."Sizes" AND z.period = q.want) THEN want ELSE latest END AS source FROM (
    SELECT 'last_3m_exact' AS scenario_id, "Sizes", idx, period, latest, CAST(period - INTERVAL 3 MONTH AS DATE) AS want FROM v_src
    UNION ALL SELECT 'same_season_last_year', "Sizes", idx, period, latest, CAST(period - INTERVAL 12 MONTH AS DATE) FROM v_src
    UNION ALL SELECT 'most_common_historical_ladder', "Sizes", idx, period, latest, common FROM v_src
    UNION ALL SELECT 'highest_historical_promo_ladder', "Sizes", idx, period, latest, deep FROM v_src
    UNION ALL SELECT 'lowest_historical_promo_ladder', "Sizes", idx, period, latest, shallow FROM v_src) q) s
JOIN v_lad l ON l."Sizes" = s."Sizes" AND l.period = s.source
""")
def scored_views(mark: str, values: str) -> None:
    """Views v_res, v_sq, v_pnl, v_sum and v_met, their names ended by `mark`, of the scenario values in the view `values`."""
    view(f"v_res{mark}", f"""
SELECT i.scenario_id, c.*, greatest(coalesce(a.value, dflt), 0) AS pct FROM (SELECT DISTINCT scenario_id FROM {values}) i CROSS JOIN v_cells c
LEFT JOIN {values} a ON a.scenario_id = i.scenario_id AND a.period = c.period AND a."Sizes" = c."Sizes" AND a."Slab" = c."Slab"
""")
    view(f"v_sq{mark}", f"""
SELECT *, greatest(baseline + comp, 0) AS pre FROM (SELECT *, b1 * pct + b2 * lagp + b3 * oth AS comp FROM (
  SELECT a.*, coalesce(lag(pct) OVER (PARTITION BY scenario_id, "Sizes", "Slab" ORDER BY idx), dlast) AS lagp, o.oth FROM v_res{mark} a
  JOIN (SELECT x.scenario_id, x."Sizes", x."Slab", x.idx, sum(y.weight * y.pct) / sum(y.weight) AS oth FROM v_res{mark} x
        JOIN v_res{mark} y ON x.scenario_id = y.scenario_id AND x."Sizes" = y."Sizes" AND x.idx = y.idx AND x."Slab" <> y."Slab" GROUP BY ALL) o USING (scenario_id, "Sizes", "Slab", idx)))
""")
    view(f"v_pnl{mark}", f"""
SELECT *, CASE "Sizes" WHEN '12-ML' THEN 12.0 ELSE 18.0 END AS ml, pre AS fin_q, baseline * dsp AS brg, pre * dsp AS srg, baseline * clp AS brn, pre * clp AS srn, baseline * clp - baseline * cogs AS bp, pre * clp - pre * cogs AS sp,
  baseline * dsp * dflt / 100 AS bi, pre * dsp * pct / 100 AS si, pre * dsp * greatest(pct - dflt, 0) / 100 AS sip FROM v_sq{mark}
""")
    view(f"v_sum{mark}", f"""
SELECT s.*, rq, rg, rn, rp, ri, rml FROM (SELECT scenario_id, coalesce("Sizes", 'TOTAL') AS "Sizes", sum(baseline) AS bq, sum(pre) AS pq, sum(fin_q) AS fq, sum(fin_q * ml) AS fml, sum(baseline * ml) AS bml, sum(brg) AS brg, sum(srg) AS srg, sum(brn) AS brn, sum(srn) AS srn,
  sum(bp) AS bp, sum(sp) AS sp, sum(bi) AS bi, sum(si) AS si, sum(sip) AS sip FROM v_pnl{mark} GROUP BY GROUPING SETS ((scenario_id, "Sizes"), (scenario_id))) s JOIN v_ref USING ("Sizes")
""")
    view(f"v_met{mark}", f"""
SELECT *, coalesce(CASE WHEN srn > 0 AND rn > 0 THEN sp / srn * 100 - rp / rn * 100 END, CASE WHEN abs(rp) > 1e-9 THEN (sp - rp) / abs(rp) * 100 ELSE 0 END) AS margin, CASE WHEN srn > 0 THEN si / srn * 100 END AS cts,
  CASE WHEN ri > 0 THEN (si - ri) / ri * 100 END AS invp, CASE WHEN rq > 0 THEN (fq - rq) / rq * 100 ELSE 0 END AS vq, CASE WHEN rml > 0 THEN (fml - rml) / rml * 100 ELSE 0 END AS vml, CASE WHEN rg > 0 THEN (srg - rg) / rg * 100 ELSE 0 END AS vr FROM v_sum{mark}
""")


view("v_ref", """
SELECT coalesce("Sizes", 'TOTAL') AS "Sizes", sum(q) AS rq, sum(g) AS rg, sum(n) AS rn, sum(n - q * cogs) AS rp, sum(inv) AS ri, sum(q * ml) AS rml FROM (
  SELECT "Sizes", CASE "Sizes" WHEN '12-ML' THEN 6.0 ELSE 8.0 END AS cogs, CASE "Sizes" WHEN '12-ML' THEN 12.0 ELSE 18.0 END AS ml, sum("Quantity") AS q, sum(dsp_amt) AS g, sum(clp_amt) AS n, sum(scheme) AS inv FROM v_db
  WHERE "Slab" <> 'slab0' AND "Month" IN (SELECT CAST(period - INTERVAL 12 MONTH AS DATE) FROM v_cells) GROUP BY 1) GROUP BY ROLLUP ("Sizes")
""")
scored_views("", "v_anch")


@query("plan_cells", """
SELECT "Sizes", "Slab", idx, period, round(dflt, 4) AS default_pct, round(baseline, 3) AS baseline_qty, round(dsp, 4) AS base_price, round(clp, 4) AS clp_price, cogs::DOUBLE AS cogs_per_unit, round(weight, 6) AS weight,
  round(greatest(baseline + b1 * dflt + b2 * dlag + b3 * odflt, 0), 3) AS default_world_qty FROM v_cells
""")
def _(spark, sf):
    c = Base(spark, sf).cells
    return r(c.select("Sizes", "Slab", "idx", "period", "default_pct", "baseline_qty", "base_price", "clp_price", "cogs_per_unit", "weight", "default_world_qty"),
             4, baseline_qty=3, default_world_qty=3, weight=6)


@query("history_ladders", """SELECT scenario_id, idx, period, "Sizes", "Slab", value FROM v_anch""")
def _(spark, sf):
    return Base(spark, sf).anchors


view("v_moved", """
SELECT *, round(least(max(round(least(greatest(target + value - low, 5), 30), 2) - pos) OVER (PARTITION BY scenario_id, "Sizes", idx ORDER BY pos), 30 - (n - 1)) + pos, 2) AS moved FROM (
  SELECT *, round(least(greatest(low + 3 * CASE WHEN idx = 1 THEN 1 ELSE 0 END, 5), 30), 2) AS target FROM (
    SELECT *, first_value(value) OVER w AS low, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY scenario_id, "Sizes", idx) AS n FROM v_anch WINDOW w AS (PARTITION BY scenario_id, "Sizes", idx ORDER BY "Slab")))
""")


@query("move_ladder", """SELECT scenario_id, idx, period, "Sizes", "Slab", moved AS value FROM v_moved""")
def _(spark, sf):
    return L.move_ladder(Base(spark, sf).anchors, "return_to_normal", "preserve_gaps", 3.0, "high", "base_high_base")


@query("enforce_ladder", """
SELECT "Sizes", period, "Slab", round(max(least(greatest(base, 5), 30)) OVER w, 2) AS ladder, max(least(greatest(round_even(base, 0), 5), 30)) OVER w AS whole FROM v_month WINDOW w AS (PARTITION BY "Sizes", period ORDER BY "Slab")
""")
def _(spark, sf):
    m = month_frame(spark, sf).select("Sizes", "period", "Slab", F.col("base_discount_pct").alias("ladder"), F.col("base_discount_pct").alias("whole"))
    return L.enforce_ladder(L.enforce_ladder(m, ["Sizes", "period"], "ladder"), ["Sizes", "period"], "whole", whole=True)


@query("enforce_bounded", """
SELECT "Sizes", period, "Slab", CASE WHEN bool_or(own OR lo > hi) OVER (PARTITION BY "Sizes", period) THEN NULL ELSE max(least(hi, greatest(least(greatest(round_even(base, 0), 5), 30), lo))) OVER (PARTITION BY "Sizes", period ORDER BY "Slab") END AS value FROM (
  SELECT *, max(l) OVER (PARTITION BY "Sizes", period ORDER BY "Slab") AS lo, min(h) OVER (PARTITION BY "Sizes", period ORDER BY "Slab" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi, l > h AS own FROM (
    SELECT *, least(greatest(floor(actual), 5), 30) AS l, least(greatest(floor(actual) + CASE "Slab" WHEN 'slab1' THEN 0 ELSE 1 END, 5), 30) AS h FROM v_month))
""")
def _(spark, sf):
    a = F.floor("actual_discount_pct").cast("double")
    m = month_frame(spark, sf).select("Sizes", "period", "Slab", F.col("base_discount_pct").alias("value"), a.alias("min_pct"),
                                      (a + F.when(F.col("Slab") == "slab1", 0).otherwise(1)).alias("max_pct"))
    return L.enforce_bounded(m, ["Sizes", "period"]).select("Sizes", "period", "Slab", "value")


@query("scenario_cross", """SELECT scenario_id, "Sizes", "Slab", idx, round(b1, 4) AS coef_base FROM v_res""")
def _(spark, sf):
    b = Base(spark, sf)
    return r(C.scenario_cross(b.anchors.select("scenario_id").distinct(), b.cells).select("scenario_id", "Sizes", "Slab", "idx", "coef_base"))


@query("resolve_scenario", """
SELECT scenario_id, "Sizes", "Slab", idx, round(pct, 4) AS scenario_pct FROM v_res
UNION ALL SELECT 'size_up', "Sizes", "Slab", idx, round(CASE WHEN "Sizes" = '12-ML' THEN dlast + 2 ELSE dflt END, 4) FROM v_cells
""")
def _(spark, sf):
    b = Base(spark, sf)
    up = b.cells.where("idx = 0 AND Sizes = '12-ML'").select(F.lit("size_up").alias("scenario_id"), "Sizes", "Slab", (F.col("default_last") + 2).alias("value"))
    return r(C.resolve_scenario(b.cells, b.values(), up).select("scenario_id", "Sizes", "Slab", "idx", "scenario_pct"))


@query("scenario_quantity", """SELECT scenario_id, "Sizes", "Slab", idx, round(lagp, 4) AS lag_pct, round(oth, 4) AS other_pct, round(comp, 3) AS discount_component, round(pre, 3) AS pre_qty FROM v_sq""")
def _(spark, sf):
    b = Base(spark, sf)
    q = C.scenario_quantity(C.resolve_scenario(b.cells, b.values()))
    return r(q.select("scenario_id", "Sizes", "Slab", "idx", "lag_pct", "other_pct", "discount_component", "pre_qty"), 4, discount_component=3, pre_qty=3)


view("v_adj", """
SELECT p.*, CASE WHEN rq > 0 THEN greatest(rq * (1 + adj / 100), 0) ELSE tot END AS target FROM (
  SELECT *, (CASE "Sizes" WHEN '12-ML' THEN o12 + e12 * o18 ELSE o18 + e18 * o12 END) / (1 - e12 * e18) AS adj FROM (
    SELECT *, max(own) FILTER ("Sizes" = '12-ML') OVER (PARTITION BY scenario_id) AS o12, max(own) FILTER ("Sizes" = '18-ML') OVER (PARTITION BY scenario_id) AS o18 FROM (
      SELECT scenario_id, "Sizes", sum(pre) AS tot, rq, (sum(pre) - rq) / rq * 100 AS own FROM v_sq JOIN v_ref USING ("Sizes") GROUP BY scenario_id, "Sizes", rq)), v_ela) p
""")


@query("cross_pack_adjust", """SELECT scenario_id, "Sizes", round(tot, 3) AS pack_pre_qty, round(adj, 5) AS adjusted_change_pct, round(target, 2) AS target_qty FROM v_adj""")
def _(spark, sf):
    b = Base(spark, sf)
    q = C.scenario_quantity(C.resolve_scenario(b.cells, b.values()))
    a = C.cross_pack_adjust(q, b.reference, b.elasticity, "solved")
    return r(a.groupBy("scenario_id", "Sizes").agg(*[F.max(c).alias(c) for c in ("pack_pre_qty", "adjusted_change_pct", "target_qty")]), 3, adjusted_change_pct=5, target_qty=2)


@query("redistribute", """
SELECT scenario_id, "Sizes", "Slab", idx, round(target * CASE WHEN tot > 0 THEN greatest(pre, 0) / tot ELSE 0 END, 3) AS final_qty FROM v_sq JOIN v_adj USING (scenario_id, "Sizes")
""")
def _(spark, sf):
    return r(Base(spark, sf).scored("solved").select("scenario_id", "Sizes", "Slab", "idx", "final_qty"), 3)


@query("scenario_pnl", """
SELECT scenario_id, "Sizes", "Slab", idx, round(srg, 2) AS scenario_revenue_gross, round(srn, 2) AS scenario_revenue_net, round(sp, 2) AS scenario_profit, round(bp, 2) AS baseline_profit, round(si, 2) AS scenario_investment, round(sip, 2) AS scenario_investment_positive FROM v_pnl
""")
def _(spark, sf):
    return r(Base(spark, sf).scored().select("scenario_id", "Sizes", "Slab", "idx", "scenario_revenue_gross", "scenario_revenue_net", "scenario_profit", "baseline_profit",
                                             "scenario_investment", "scenario_investment_positive"), 2)


@query("scenario_months", """
SELECT scenario_id, period, "Sizes", round(sum(fin_q), 3) AS final_qty, round((sum(fin_q) - sum(baseline)) / sum(baseline) * 100, 5) AS volume_delta_pct, round((sum(srg) - sum(brg)) / sum(brg) * 100, 5) AS revenue_delta_pct,
  round((sum(sp) - sum(bp)) / abs(sum(bp)) * 100, 5) AS profit_delta_pct FROM v_pnl GROUP BY ALL
""")
def _(spark, sf):
    m = C.scenario_months(Base(spark, sf).scored())
    return r(m.select("scenario_id", "period", "Sizes", "final_qty", "volume_delta_pct", "revenue_delta_pct", "profit_delta_pct"), 5, final_qty=3)


@query("scenario_summary", """
SELECT scenario_id, "Sizes", round(bq, 3) AS baseline_qty, round(fq, 3) AS final_qty, round(fml, 2) AS final_ml, round(srg, 2) AS scenario_revenue_gross, round(sp, 2) AS scenario_profit, round(si, 2) AS scenario_investment, round(rq, 3) AS reference_qty,
  round((fq - rq) / rq * 100, 5) AS vs_reference_volume_pct, round((srg - rg) / rg * 100, 5) AS vs_reference_revenue_gross_pct, round((sp - rp) / abs(rp) * 100, 5) AS vs_reference_profit_pct, round((si - ri) / ri * 100, 5) AS vs_reference_investment_pct FROM v_sum
""")
def _(spark, sf):
    b = Base(spark, sf)
    s = C.scenario_summary(b.scored(), b.reference)
    return r(s.select("scenario_id", "Sizes", "baseline_qty", "final_qty", "final_ml", "scenario_revenue_gross", "scenario_profit", "scenario_investment", "reference_qty", "vs_reference_volume_pct",
                      "vs_reference_revenue_gross_pct", "vs_reference_profit_pct", "vs_reference_investment_pct"), 5, baseline_qty=3, final_qty=3, final_ml=2,
             scenario_revenue_gross=2, scenario_profit=2, scenario_investment=2, reference_qty=3)


@query("scenario_metrics", """SELECT scenario_id, "Sizes", round(margin, 5) AS net_margin_points, round(cts, 5) AS cts_pct, round(invp, 5) AS investment_pct FROM v_met""")
def _(spark, sf):
    return r(Base(spark, sf).metrics().select("scenario_id", "Sizes", "net_margin_points", "cts_pct", "investment_pct"), 5)


@query("scenario_thresholds", """
SELECT scenario_id FROM v_met WHERE "Sizes" = 'TOTAL' AND vml >= (SELECT avg(vml) FROM v_met WHERE "Sizes" = 'TOTAL') AND cts <= 100 AND scenario_id IN (SELECT scenario_id FROM v_met WHERE "Sizes" = '12-ML' AND vq >= -60)
""")
def _(spark, sf):
    m = cut(Base(spark, sf).metrics())
    middle = m.where("Sizes = 'TOTAL'").agg(F.avg("vs_reference_ml_pct")).first()[0]
    return C.scenario_thresholds(m, min_volume=middle, min_pack_volume={"12-ML": -60.0}, max_cts=100.0).select("scenario_id")


@query("rank_scenarios", """
SELECT scenario_id, CAST(row_number() OVER (ORDER BY margin DESC NULLS LAST, vr DESC NULLS LAST, vml DESC NULLS LAST, scenario_id) AS INTEGER) AS rank, round(margin, 5) AS net_margin_points, round(vr, 5) AS revenue_pct FROM v_met WHERE "Sizes" = 'TOTAL'
""")
def _(spark, sf):
    t = C.rank_scenarios(Base(spark, sf).metrics().where("Sizes = 'TOTAL'"), "profit")
    return r(t.select("scenario_id", F.col("rank").cast("int").alias("rank"), "net_margin_points", F.col("vs_reference_revenue_gross_pct").alias("revenue_pct")), 5)


@query("cell_bounds", """
SELECT DISTINCT scenario_id FROM v_anch WHERE scenario_id NOT IN (
  SELECT i.scenario_id FROM (SELECT DISTINCT scenario_id FROM v_anch) i CROSS JOIN v_cells c LEFT JOIN v_anch a ON a.scenario_id = i.scenario_id AND a.period = c.period AND a."Sizes" = c."Sizes" AND a."Slab" = c."Slab"
  WHERE c.idx = 1 AND (a.value IS NULL OR a.value < c.dflt - 2.5 OR a.value > c.dflt + 2.5))
""")
def _(spark, sf):
    b = Base(spark, sf)
    bounds = b.cells.where("idx = 1").select("period", "Sizes", "Slab", (F.col("default_pct") - 2.5).alias("min_pct"), (F.col("default_pct") + 2.5).alias("max_pct"))
    return C.cell_bounds(b.values(), bounds)


@query("reference_totals", """SELECT "Sizes", round(rq, 3) AS reference_qty, round(rg, 2) AS reference_revenue_gross, round(rn, 2) AS reference_revenue_net, round(rp, 2) AS reference_profit, round(ri, 2) AS reference_investment FROM v_ref""")
def _(spark, sf):
    return r(Base(spark, sf).reference.drop("reference_available", "reference_ml"), 2, reference_qty=3)


view("v_cr", """
SELECT scenario_id, "Sizes", "Slab", 0 AS it, anchor::DOUBLE AS q, 0.0::DOUBLE AS oth, FALSE AS done FROM v_res WHERE idx = 0
UNION ALL
SELECT scenario_id, "Sizes", "Slab", it + 1, CASE WHEN done THEN q ELSE nq END, CASE WHEN done THEN oth ELSE no END, done OR d <= 1e-6 FROM (
  SELECT *, sum(abs(nq - q)) OVER (PARTITION BY scenario_id, "Sizes") AS d FROM (
    SELECT *, greatest(intercept + b0 * resid + b1 * pct + b2 * lastlag + b3 * no, 0) AS nq FROM (
      SELECT *, CASE WHEN count(CASE WHEN w > 0 THEN 1 END) OVER p - CASE WHEN w > 0 THEN 1 ELSE 0 END > 0 THEN (sum(w * pct) OVER p - w * pct) / (sum(w) OVER p - w) ELSE 0 END AS no FROM (
        SELECT c.*, r.intercept, r.b0, r.b1, r.b2, r.b3, r.resid, r.lastlag, r.pct,
          CASE WHEN sum(greatest(q, 0)) OVER g > 0 THEN greatest(q, 0) / sum(greatest(q, 0)) OVER g ELSE 1.0 / count(*) OVER g END AS w
        FROM v_cr c JOIN v_res r ON r.scenario_id = c.scenario_id AND r."Sizes" = c."Sizes" AND r."Slab" = c."Slab" AND r.idx = 0 WHERE it < 8
        WINDOW g AS (PARTITION BY c.scenario_id, c."Sizes"))
      WINDOW p AS (PARTITION BY scenario_id, "Sizes"))))
""")


@query("coupled_response", """
SELECT scenario_id, "Sizes", "Slab", round(q, 3) AS qty, round(CASE WHEN sum(q) OVER g > 0 THEN q / sum(q) OVER g ELSE 1.0 / count(*) OVER g END, 5) AS weight, round(oth, 4) AS other
FROM v_cr WHERE it = 8 WINDOW g AS (PARTITION BY scenario_id, "Sizes")
""")
def _(spark, sf):
    b = Base(spark, sf)
    d = C.resolve_scenario(b.cells, b.values()).where("idx = 0")
    return r(C.coupled_response(d).select("scenario_id", "Sizes", "Slab", "qty", "weight", "other"), 4, qty=3, weight=5)


_WIDE = [(i, size, f"slab{k}") for i in range(3) for size, n in (("12-ML", 2), ("18-ML", 4)) for k in range(1, n + 1)]


@query("scenario_wide", "SELECT scenario_id, " + ", ".join(f"""max(value) FILTER (idx = {i} AND "Sizes" = '{z}' AND "Slab" = '{b}') AS "m{i + 1}_{z}_{b}\"""" for i, z, b in _WIDE) + " FROM v_anch GROUP BY 1")
def _(spark, sf):
    return C.scenario_wide(Base(spark, sf).anchors, _WIDE)


@query("allocate_counts", """
SELECT "Final_State", slab, CAST(b + f + CASE WHEN row_number() OVER (PARTITION BY "Final_State" ORDER BY raw - f DESC, slab DESC) <= 50 - sum(b + f) OVER (PARTITION BY "Final_State") THEN 1 ELSE 0 END AS INTEGER) AS allocated FROM (
  SELECT *, 1 AS b, floor(raw) AS f FROM (SELECT "Final_State", "Slab" AS slab, sum("Quantity") / sum(sum("Quantity")) OVER (PARTITION BY "Final_State") * (50 - count(*) OVER (PARTITION BY "Final_State")) AS raw FROM txn GROUP BY 1, 2))
""")
def _(spark, sf):
    g = txn(spark, sf, "Final_State", "Slab", "Quantity").groupBy("Final_State", F.col("Slab").alias("slab")).agg(F.sum("Quantity").alias("weight"))
    return C.allocate_counts(g, ["Final_State"], 50, order="slab").select("Final_State", "slab", "allocated")


_AV = """
SELECT "Sizes", "Slab", idx, round(max(least(greatest(lm, 5), 30)) OVER w, 2) AS latest_month, round(max(least(greatest(l3, 5), 30)) OVER w, 2) AS last_3m_avg, round(max(least(greatest(ly, 5), 30)) OVER w, 2) AS ly_same_3m,
  round(max(least(greatest(se, 5), 30)) OVER w, 2) AS stress_explore FROM (
  SELECT *, dlast AS lm, av + [-st, 0, st][idx + 1] AS l3, CASE WHEN sp < 1e-9 THEN av + [1.5, -0.5, 1.0][idx + 1] ELSE dflt END AS ly,
    av + [-(am + 0.5), am * 0.5, am + 1.0][idx + 1] + CASE "Sizes" WHEN '12-ML' THEN 0.8 ELSE -0.6 END + CASE WHEN "Slab" IN ('slab3', 'slab4') THEN 0.4 ELSE 0 END AS se FROM (
    SELECT *, greatest(1.0, least(2.5, CASE WHEN sp > 0 THEN sp ELSE 1.5 END)) AS st, greatest(2.0, least(6.0, sp + 2)) AS am FROM (
      SELECT *, avg(dflt) OVER p AS av, max(dflt) OVER p - min(dflt) OVER p AS sp FROM v_cells WINDOW p AS (PARTITION BY "Sizes", "Slab"))))
WINDOW w AS (PARTITION BY "Sizes", idx ORDER BY "Slab")
"""


@query("anchor_vectors", _AV)
def _(spark, sf):
    return C.anchor_vectors(Base(spark, sf).cells).drop("period", "default_pct")


def family_rows(spark, sf):
    """Three raw families per state from its slab table; some fields lie out of range on purpose."""
    g = D.discount_basis(txn(spark, sf, *BASIS, "Final_State", "Slab").where(K.allowed_slab("Slab"))).groupBy("Final_State", "Slab").agg(
        (F.sum("scheme_amount") / F.sum("dsp_sales") * 100).alias("d"), F.sum("Quantity").alias("q"))
    s, k = F.regexp_extract("Final_State", r"(\d+)", 1).cast("int"), K.slab_number("Slab")
    pattern = F.element_at(F.array(*[F.lit(p) for p in ("flat", "UP", "down", "wave", "zigzag")]), (s + k) % 5 + 1)
    mix = F.struct(*[(s % (i + 2) + i * k % 3).cast("double").alias(a) for i, a in enumerate(C.ANCHOR_KEYS)])
    return g.select(F.col("Final_State").alias("plan"), (k - 1).alias("family"), F.lit("").alias("name"), F.col("q").alias("priority_weight"), (F.col("d") + s % 4).alias("base_min"),
                    (F.col("d") - k + s % 3).alias("base_max"), (s % 3).alias("gap_min"), k.alias("gap_max"), pattern.alias("month_pattern"), (s % 9).alias("month_shift_strength"),
                    (s % 17 - 8).alias("size_bias_12"), (k - s % 5).alias("size_bias_18"), (s % 8).alias("volatility"), mix.alias("anchor_weights"))


@query("sanitize_families", """
SELECT plan, family, 'Family ' || (family + 1) AS name, lo AS base_min, CASE WHEN hi - lo < 2 THEN least(30, lo + 2) ELSE hi END AS base_max, glo AS gap_min, CASE WHEN ghi - glo < 1 THEN least(10, glo + 1) ELSE ghi END AS gap_max,
  pat AS month_pattern, least(6, s % 9)::INTEGER AS month_shift_strength, least(6, greatest(-6, s % 17 - 8))::INTEGER AS size_bias_12, least(6, s % 8)::INTEGER AS volatility FROM (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, least(greatest(1, s % 3), k) AS glo, greatest(greatest(1, s % 3), k) AS ghi FROM (
    SELECT "Final_State" AS plan, k - 1 AS family, s, k, CAST(least(30, greatest(5, round_even(d + s % 4, 0))) AS INTEGER) AS a, CAST(least(30, greatest(5, round_even(d - k + s % 3, 0))) AS INTEGER) AS b,
      ['flat', 'up', 'down', 'wave', 'flat'][(s + k) % 5 + 1] AS pat FROM (
      SELECT "Final_State", CAST(regexp_extract("Final_State", '[0-9]+') AS INTEGER) AS s, CAST(regexp_extract("Slab", '[0-9]+') AS INTEGER) AS k, sum(scheme) / sum(dsp_amt) * 100 AS d FROM v_tb WHERE "Slab" <> 'slab0' GROUP BY ALL)))
""")
def _(spark, sf):
    return FM.sanitize_families(family_rows(spark, sf)).select(
        "plan", "family", "name", "base_min", "base_max", "gap_min", "gap_max", "month_pattern", "month_shift_strength", "size_bias_12", "volatility")


_NUMBERS = list(FM.RANGES)


def _like_sql(a, b):
    near = " + ".join(f"greatest(0, 1 - abs({a}.{k} - {b}.{k}) / {v})" for k, v in FM.SPANS.items())
    gap = " + ".join(f"abs({a}.{k} - {b}.{k})" for k in C.ANCHOR_KEYS)
    return f"(CASE WHEN {a}.month_pattern = {b}.month_pattern THEN 0.35 ELSE 0 END + 0.45 * ({near}) / {len(FM.SPANS)} + 0.20 * greatest(0, 1 - ({gap}) / 2))"


def _default_sql(i):
    d = FM.DEFAULTS[i]
    parts = [f"name := '{d['name']}'", f"priority_weight := {d['priority_weight']}::DOUBLE", *[f"{k} := {d[k]}" for k in _NUMBERS], f"month_pattern := '{d['month_pattern']}'",
             *[f"{k} := {w}::DOUBLE" for k, w in zip(C.ANCHOR_KEYS, d["anchor_weights"])]]
    return f"struct_pack({', '.join(parts)})"


def _wide_sql(f, i):
    """The changes of a family set apart, as the inventory states them."""
    mix = {k: f"(0.7 * {f}.{k} + 0.3 * {w})" for k, w in zip(C.ANCHOR_KEYS, FM.DEFAULTS[i]["anchor_weights"])}
    whole = " + ".join(mix.values())
    low, t = f"greatest(5, {f}.base_min - {1 + i % 2})", 1 if i % 2 == 0 else -1
    pattern = "CASE " + " ".join(f"WHEN {f}.month_pattern = '{x}' THEN '{y}'" for x, y in zip(FM.PATTERNS, FM.PATTERNS[1:] + FM.PATTERNS[:1])) + " END"
    new = {"name": f"{f}.name || ' (diversified)'", "priority_weight": f"{f}.priority_weight", "base_min": low, "base_max": f"greatest(least(30, {f}.base_max + 2), least(30, {low} + 3))",
           "gap_min": f"greatest(1, {f}.gap_min)", "gap_max": f"least(10, greatest({f}.gap_max + 1, {f}.gap_min + 1))", "month_shift_strength": f"least(6, {f}.month_shift_strength + 1)",
           "size_bias_12": f"greatest(-6, least(6, {f}.size_bias_12 + {t}))", "size_bias_18": f"greatest(-6, least(6, {f}.size_bias_18 - {t}))",
           "volatility": f"least(6, greatest(2, {f}.volatility + 1))", "month_pattern": pattern, **{k: f"{v} / ({whole})" for k, v in mix.items()}}
    return f"struct_pack({', '.join(f'{k} := {v}' for k, v in new.items())})"


def _settled_sql(raw):
    """The three families of every plan of `raw` (plan, family, f), set apart where two are alike."""
    step = f"SELECT plan, max(f) FILTER (family = 0) AS f0, max(f) FILTER (family = 1) AS f1, max(f) FILTER (family = 2) AS f2 FROM ({raw}) GROUP BY plan"
    for i, j in ((0, 1), (0, 2), (1, 2)):
        step = (f"SELECT * EXCLUDE (w) REPLACE (CASE WHEN {_like_sql(f'f{i}', f'f{j}')} < {FM.SIMILAR} THEN f{j} WHEN {_like_sql(f'f{i}', 'w')} >= {FM.SIMILAR} THEN {_default_sql(j)} ELSE w END AS f{j}) "
                f"FROM (SELECT *, {_wide_sql(f'f{j}', j)} AS w FROM ({step}))")
    return f"SELECT plan, unnest([0, 1, 2]) AS family, unnest([f0, f1, f2]) AS f FROM ({step})"


def _families_sql():
    rng = lambda k, e: f"CAST(greatest({FM.RANGES[k][0]}, least({FM.RANGES[k][1]}, {e})) AS INTEGER)"
    mix = [f"(s % {i + 2} + {i} * k % 3)" for i in range(4)]
    raw = f"""SELECT plan, k - 1 AS family, struct_pack(name := 'Family ' || k, priority_weight := q, base_min := lo, base_max := CASE WHEN hi - lo < 2 THEN least(30, lo + 2) ELSE hi END,
      gap_min := glo, gap_max := CASE WHEN ghi - glo < 1 THEN least(10, glo + 1) ELSE ghi END, month_shift_strength := {rng('month_shift_strength', 's % 9')},
      size_bias_12 := {rng('size_bias_12', 's % 17 - 8')}, size_bias_18 := {rng('size_bias_18', 'k - s % 5')}, volatility := {rng('volatility', 's % 8')}, month_pattern := pat,
      {', '.join(f"{a} := CASE WHEN {'+'.join(mix)} > 0 THEN {m}::DOUBLE / ({'+'.join(mix)}) ELSE 0.25 END" for a, m in zip(C.ANCHOR_KEYS, mix))}) AS f FROM (
      SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, least({rng('gap_min', 's % 3')}, {rng('gap_max', 'k')}) AS glo, greatest({rng('gap_min', 's % 3')}, {rng('gap_max', 'k')}) AS ghi FROM (
        SELECT "Final_State" AS plan, s, k, q, {rng('base_min', 'round_even(d + s % 4, 0)')} AS a, {rng('base_max', 'round_even(d - k + s % 3, 0)')} AS b,
          ['flat', 'up', 'down', 'wave', 'flat'][(s + k) % 5 + 1] AS pat FROM (
          SELECT "Final_State", CAST(regexp_extract("Final_State", '[0-9]+') AS INTEGER) AS s, CAST(regexp_extract("Slab", '[0-9]+') AS INTEGER) AS k, sum(scheme) / sum(dsp_amt) * 100 AS d, sum("Quantity") AS q
          FROM v_tb WHERE "Slab" <> 'slab0' GROUP BY ALL)))"""
    fields = ", ".join(f"f.{k}" for k in _NUMBERS) + ", f.month_pattern, " + ", ".join(f"round(f.{a}, 6) AS {a}" for a in C.ANCHOR_KEYS)
    return f"""SELECT plan, family, f.name, round(f.priority_weight / sum(f.priority_weight) OVER (PARTITION BY plan), 6) AS priority_weight, {fields}
FROM ({_settled_sql(raw)})"""


@query("scenario_families", _families_sql())
def _(spark, sf):
    f = FM.scenario_families(family_rows(spark, sf))
    return r(f.select(*[c for c in f.columns if c != "anchor_weights"], *[F.col(f"anchor_weights.{a}").alias(a) for a in C.ANCHOR_KEYS]), 6)


def generated(spark, sf, count):
    b = Base(spark, sf)
    fam = C.allocate_counts(FM.scenario_families(FM.default_families(spark)), ["plan"], count, "priority_weight")
    return b, C.generate_scenarios(fam, b.cells, seed=11)


def _draw_sql(*parts):
    """The draw of a key in [0, 1): 52 bits of the md5 of the seed and the parts."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '11', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _whole_sql(low, high, *parts):
    return f"({low} + floor({_draw_sql(*parts)} * ({high} - ({low}) + 1)))"


_CAND, _SPOT = ["plan", "family", "candidate"], ["plan", "family", "candidate", '"Sizes"', "idx"]
_SHARES = [" + ".join(["0.0", *[f"f.{a}" for a in C.ANCHOR_KEYS[:i + 1]]]) for i in range(3)]
view("v_alloc", f"""
SELECT plan, family, f, CAST(1 + fl + CASE WHEN row_number() OVER (PARTITION BY plan ORDER BY part - fl DESC, family DESC) <= 1000 - sum(1 + fl) OVER (PARTITION BY plan) THEN 1 ELSE 0 END AS INTEGER) AS allocated
FROM (SELECT *, floor(part) AS fl FROM (SELECT *, w / sum(w) OVER (PARTITION BY plan) * (1000 - count(*) OVER (PARTITION BY plan)) AS part FROM (
  SELECT *, f.priority_weight / sum(f.priority_weight) OVER (PARTITION BY plan) AS w FROM (
    {_settled_sql("SELECT 'default' AS plan, unnest([0, 1, 2]) AS family, unnest([" + ", ".join(_default_sql(i) for i in range(3)) + "]) AS f")}))))
""")
view("v_av", _AV)
view("v_drawn", f"""
SELECT plan, family, candidate, allocated, anchor, "Sizes", "Slab", idx, round_even(round(max(least(30.0, greatest(5.0, run))) OVER w, 2), 0) AS value FROM (
  SELECT *, sum(part) OVER w AS run FROM (
    SELECT *, CASE WHEN prev IS NULL THEN least(30.0, greatest(5.0, greatest(f.base_min, least(f.base_max, a + CASE "Sizes" WHEN '12-ML' THEN f.size_bias_12 ELSE f.size_bias_18 END
      + CASE f.month_pattern WHEN 'up' THEN idx * f.month_shift_strength WHEN 'down' THEN -idx * f.month_shift_strength WHEN 'wave' THEN [0, 1, -1][idx % 3 + 1] * f.month_shift_strength
        WHEN 'pulse' THEN [1, 0, 1][idx % 3 + 1] * f.month_shift_strength ELSE 0 END
      + CASE WHEN f.volatility > 0 THEN {_whole_sql("-f.volatility", "f.volatility", "'noise'", *_SPOT)} ELSE 0 END + {_whole_sql("-1", "1", "'base'", *_SPOT)}))))
      ELSE greatest(f.gap_min, least(f.gap_max, greatest(1, round_even(a - prev, 0)) + {_whole_sql("-1", "1", "'gap'", *_SPOT, '"Slab"')})) END AS part FROM (
      SELECT *, lag(a) OVER w AS prev FROM (
        SELECT c.*, "Sizes", "Slab", idx, CASE anchor {" ".join(f"WHEN '{a}' THEN v.{a}" for a in C.ANCHOR_KEYS)} END AS a FROM (
          SELECT *, CASE {" ".join(f"WHEN u <= {x} THEN '{a}'" for x, a in zip(_SHARES, C.ANCHOR_KEYS))} ELSE '{C.ANCHOR_KEYS[-1]}' END AS anchor FROM (
            SELECT *, {_draw_sql("'anchor'", *_CAND)} AS u FROM (SELECT *, unnest(range(0, 4 * allocated)) AS candidate FROM v_alloc))) c CROSS JOIN v_av v)
      WINDOW w AS (PARTITION BY plan, family, candidate, "Sizes", idx ORDER BY "Slab")))
  WINDOW w AS (PARTITION BY plan, family, candidate, "Sizes", idx ORDER BY "Slab"))
WINDOW w AS (PARTITION BY plan, family, candidate, "Sizes", idx ORDER BY "Slab")
""")
view("v_gkept", """
SELECT plan, signature, unnest(arg_min({'family': family, 'candidate': candidate, 'allocated': allocated}, (candidate, family))) FROM (
  SELECT plan, family, candidate, any_value(allocated) AS allocated, list(value ORDER BY "Sizes", idx, "Slab") AS signature, count(DISTINCT value) AS u, max(value) AS hi, min(value) AS lo FROM v_drawn GROUP BY ALL)
JOIN (SELECT plan, family, candidate, count(DISTINCT s) AS shapes FROM (SELECT plan, family, candidate, idx, list(value ORDER BY "Sizes", "Slab") AS s FROM v_drawn GROUP BY ALL) GROUP BY ALL) USING (plan, family, candidate)
WHERE u > 2 AND hi > 6 AND hi - lo > 2 AND shapes > 1 GROUP BY plan, signature
""")
view("v_gchosen", """
SELECT plan, family, candidate FROM (
  SELECT *, row_number() OVER (PARTITION BY plan, own ORDER BY candidate * 1000 + family) AS turn, 1000 - count(*) FILTER (own) OVER (PARTITION BY plan) AS lack FROM (
    SELECT *, row_number() OVER (PARTITION BY plan, family ORDER BY candidate) <= allocated AS own FROM v_gkept)) WHERE own OR turn <= lack
""")
view("v_gen", """
SELECT plan, printf('%s-f%d-%06d', plan, family, candidate) AS scenario_id, family, anchor, "Sizes", "Slab", idx, (SELECT max(period) FROM v_cells c WHERE c.idx = d.idx) AS period, value
FROM v_drawn d JOIN v_gchosen USING (plan, family, candidate)
""")
scored_views("_g", "v_gen")


@query("generate_scenarios", """SELECT plan, scenario_id, family, anchor, "Sizes", "Slab", idx, period, value FROM v_gen""")
def _(spark, sf):
    return generated(spark, sf, 1000)[1]


@query("generated_by_plan", """
SELECT r_name AS plan, 40 AS scenarios, 40 AS distinct_scenarios, TRUE AS cells_once, TRUE AS in_range, TRUE AS rising FROM region
""")
def _(spark, sf):
    """Every region is a plan of its own; each gets what it asked for, without repeats, gaps or falling ladders."""
    cells = Base(spark, sf).cells
    plans = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("plan"))
    raw = plans.join(FM.default_families(spark).drop("plan"))
    g = cut(C.generate_scenarios(C.allocate_counts(FM.scenario_families(raw), ["plan"], 40, "priority_weight"), cells, seed=3))
    ladder = Window.partitionBy("scenario_id", "Sizes", "idx").orderBy(K.slab_number("Slab"))
    g = g.withColumn("up", F.coalesce(F.col("value") >= F.lag("value").over(ladder), F.lit(True)))
    cell = F.struct("idx", "Sizes", "Slab", "value")
    s = g.groupBy("plan", "scenario_id").agg(F.array_sort(F.collect_list(cell)).alias("v"), F.count_distinct("idx", "Sizes", "Slab").alias("n"),
                                             F.bool_and(F.col("value").between(5, 30)).alias("inside"), F.bool_and("up").alias("up"))
    n = cells.agg(F.count("*")).scalar()
    return s.groupBy("plan").agg(F.count_distinct("scenario_id").cast("int").alias("scenarios"), F.count_distinct(F.to_json("v")).cast("int").alias("distinct_scenarios"),
                                 F.bool_and((F.size("v") == n) & (F.col("n") == n)).alias("cells_once"), F.bool_and("inside").alias("in_range"), F.bool_and("up").alias("rising"))


@query("score_generated", """
SELECT scenario_id, "Sizes", round(bq, 3) AS baseline_qty, round(fq, 3) AS final_qty, round(fml, 2) AS final_ml, round(srg, 2) AS scenario_revenue_gross, round(sp, 2) AS scenario_profit, round(si, 2) AS scenario_investment, round(rq, 3) AS reference_qty,
  round(vq, 5) AS vs_reference_volume_pct, round(vml, 5) AS vs_reference_ml_pct, round(vr, 5) AS vs_reference_revenue_gross_pct, round(margin, 5) AS net_margin_points, round(cts, 5) AS cts_pct, round(invp, 5) AS investment_pct FROM v_met_g
""")
def _(spark, sf):
    b, g = generated(spark, sf, 1000)
    g = cut(g)
    s = C.scenario_metrics(C.scenario_summary(C.score_scenarios(b.cells, g.select("scenario_id", "period", "Sizes", "Slab", "value"), b.reference), b.reference))
    return r(s.select("scenario_id", "Sizes", "baseline_qty", "final_qty", "final_ml", "scenario_revenue_gross", "scenario_profit", "scenario_investment", "reference_qty", "vs_reference_volume_pct",
                      "vs_reference_ml_pct", "vs_reference_revenue_gross_pct", "net_margin_points", "cts_pct", "investment_pct"), 5, baseline_qty=3, final_qty=3, final_ml=2,
             scenario_revenue_gross=2, scenario_profit=2, scenario_investment=2, reference_qty=3)


view("v_many", """
SELECT "Final_State" || '/' || y AS scenario_id, "Sizes", "Slab", idx, round(v, 0) AS value FROM (
  SELECT "Final_State", year("Date") AS y, "Sizes", "Slab", CAST((month("Date") - 1) % 3 AS INTEGER) AS idx, sum(scheme) / sum(dsp_amt) * 100 AS v FROM v_tb WHERE "Slab" <> 'slab0' GROUP BY ALL)
""")


@query("drop_degenerate", """
SELECT m.* FROM v_many m WHERE scenario_id IN (SELECT min(scenario_id) FROM (
  SELECT scenario_id, string_agg(idx || "Sizes" || "Slab" || value, ',' ORDER BY idx, "Sizes", "Slab") AS sig, count(DISTINCT value) AS u, max(value) AS hi, min(value) AS lo FROM v_many GROUP BY 1)
  JOIN (SELECT scenario_id, count(DISTINCT s) AS shapes FROM (SELECT scenario_id, idx, list(value ORDER BY "Sizes", "Slab") AS s FROM v_many GROUP BY ALL) GROUP BY 1) USING (scenario_id)
  WHERE u > 2 AND hi > 6 AND hi - lo > 2 AND shapes > 1 GROUP BY sig)
""")
def _(spark, sf):
    g = D.discount_basis(txn(spark, sf, *BASIS, "Final_State", "Slab").where(K.allowed_slab("Slab"))).groupBy(
        F.concat("Final_State", F.lit("/"), F.year("Date")).alias("scenario_id"), "Sizes", "Slab", ((F.month("Date") - 1) % 3).alias("idx")).agg(
        F.round(F.sum("scheme_amount") / F.sum("dsp_sales") * 100, 0).alias("value"))
    return C.drop_degenerate(g)
