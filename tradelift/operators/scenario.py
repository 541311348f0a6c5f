"""Scenario planning across pack sizes: any number of scenarios in one plan.

Everything after the slab state is keyed by scenario_id. Cells (month x size x slab) are few, so the
cell table rides along as one array value and is exploded per scenario; rows are then partitioned
once by scenario_id and every window below reuses that partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.functions.columns import delta_pct, delta_pct_abs, half_even, positive_ratio, slab_number
from tradelift.functions.lineage import cut
from tradelift.operators import forecast as O, ladder as L, ranking, sequence as Q
from tradelift.operators.fit import OTHER
from tradelift.schema import LADDER_MAX, LADDER_MIN

CELL = ["Sizes", "Slab", "idx"]
DRAWN = ["plan", "family", "candidate"]
ANCHOR_KEYS = ["latest_month", "last_3m_avg", "ly_same_3m", "stress_explore"]
MONEY = ["baseline_revenue_gross", "scenario_revenue_gross", "baseline_revenue_net", "scenario_revenue_net",
         "baseline_profit", "scenario_profit", "baseline_investment", "scenario_investment", "scenario_investment_positive"]


def pack_ml(size="Sizes") -> Column:
    v = F.regexp_extract(size, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(v > 0, v).otherwise(1.0)


def plan_cells(model_rows: DataFrame, weights: DataFrame, cogs: Column, horizon: int = 3, order="period") -> DataFrame:
    """One row per size, slab and plan month: default discount, no-discount baseline, prices, cost,
    coefficients and modelled weight. Plan months follow the last month seen anywhere."""
    keys = ["Sizes", "Slab"]
    last = Q.latest_per_group(model_rows, keys, order)
    clp = positive_ratio("clp_sales", "quantity") if "clp_sales" in model_rows.columns else F.lit(None).cast("double")
    state = last.select(
        *keys, F.greatest("quantity", F.lit(1.0)).alias("anchor_qty"), "residual_store",
        F.col("lag1_base_discount_pct").alias("last_lag"), "base_price", F.coalesce(clp, F.col("base_price")).alias("clp_price"),
        cogs.alias("cogs_per_unit"), F.col("base_discount_pct").alias("default_last"), "intercept", F.col("coef_residual_store").alias("coef_residual"),
        F.col("coef_base_discount_pct").alias("coef_base"), F.coalesce("coef_lag1_base_discount_pct", F.lit(0.0)).alias("coef_lag"),
        F.col(f"coef_{OTHER}").alias("coef_other"))
    defaults = Q.trailing_series(model_rows, keys, order, "base_discount_pct", horizon).withColumnRenamed("base_discount_pct", "default_pct")
    resid = O.trend_forecast(model_rows.select(*keys, order, "residual_store"), keys, order, "residual_store", horizon, floor=False).select(
        *keys, (F.col("step") - 1).alias("idx"), F.col("residual_store").alias("residual_ahead"))
    end = model_rows.agg(F.max(order)).scalar()
    d = state.join(defaults, keys).join(resid, [*keys, "idx"]).join(weights.select(*keys, "weight"), keys, "left")
    d = d.withColumns({
        "weight": F.coalesce("weight", F.lit(0.0)), "period": F.add_months(end, F.col("idx") + 1),
        "baseline_qty": F.greatest(F.col("intercept") + F.col("coef_residual") * F.col("residual_ahead"), F.lit(0.0))})
    d = d.withColumn("default_lag", F.when(F.col("idx") > 0, F.col("default_pct")).otherwise(F.col("default_last")))
    d = d.withColumn("other_default", _other_mean("default_pct", ["Sizes", "idx"]))
    part = F.col("coef_base") * F.col("default_pct") + F.col("coef_lag") * F.col("default_lag") + F.col("coef_other") * F.col("other_default")
    return d.withColumn("default_world_qty", F.greatest(F.col("baseline_qty") + part, F.lit(0.0)))


def _other_mean(value: str, keys, weight: str = "weight") -> Column:
    """Weighted mean over the other slabs with a positive weight; 0 if there are none."""
    w = Window.partitionBy(*keys)
    live = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    n = F.count_if(F.col(weight) > 0).over(w) - F.when(F.col(weight) > 0, 1).otherwise(0)
    num = F.sum(live * F.col(value)).over(w) - live * F.col(value)
    den = F.sum(live).over(w) - live
    return F.when(n > 0, num / den).otherwise(0.0)


def scenario_cross(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """Every scenario with every cell. The cells travel as one bounded array."""
    names = cells.columns
    packed = cells.agg(F.collect_list(F.struct(*names))).scalar()
    return ids.select("scenario_id", F.explode(packed).alias("c")).select("scenario_id", *[F.col(f"c.{n}").alias(n) for n in names])


def resolve_scenario(cells: DataFrame, months: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Cell values per scenario: the month override, else the size override, else the default, not below
    zero. `months` holds (scenario_id, period, Sizes, Slab, value), `sizes` the same without period."""
    m = months.select("scenario_id", "period", "Sizes", "Slab", F.col("value").alias("__m"))
    ids = m.select("scenario_id")
    if sizes is not None:
        ids = ids.union(sizes.select("scenario_id"))
    d = scenario_cross(ids.distinct(), cells).join(m, ["scenario_id", "period", "Sizes", "Slab"], "left")
    by_size = F.lit(None).cast("double")
    if sizes is not None:
        d = d.join(sizes.select("scenario_id", "Sizes", "Slab", F.col("value").alias("__s")), ["scenario_id", "Sizes", "Slab"], "left")
        by_size = F.col("__s")
    return d.withColumn("scenario_pct", F.greatest(F.coalesce("__m", by_size, F.col("default_pct")), F.lit(0.0))).drop("__m", "__s")


def scenario_quantity(resolved: DataFrame) -> DataFrame:
    """Quantity of every cell before any pack adjustment: baseline + own + lag + other slabs, floor 0.
    The first month's lag is the last known base."""
    d = resolved.repartition("scenario_id")
    lag = F.lag("scenario_pct").over(Window.partitionBy("scenario_id", "Sizes", "Slab").orderBy("idx"))
    d = d.withColumns({
        "lag_pct": F.coalesce(lag, F.col("default_last")),
        "other_pct": _other_mean("scenario_pct", ["scenario_id", "Sizes", "idx"])})
    part = F.col("coef_base") * F.col("scenario_pct") + F.col("coef_lag") * F.col("lag_pct") + F.col("coef_other") * F.col("other_pct")
    return d.withColumns({"discount_component": part, "pre_qty": F.greatest(F.col("baseline_qty") + part, F.lit(0.0))})


def reference_totals(basis: DataFrame, cells: DataFrame, cogs: Column, mode: str = "ly_same_3m") -> DataFrame:
    """Reference quantity, gross and net revenue, profit and investment per pack and in TOTAL: the same
    months last year, or the three before the plan."""
    months = cells.select("period").distinct()
    if mode == "last_3m_before_projection":
        ref = months.agg(F.min("period").alias("p")).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "p").select(
            F.add_months("p", -F.col("k")).alias("ref"))
    else:
        ref = months.select(F.add_months("period", -12).alias("ref"))
    # a plan has a few months; as ranges of Date they reach the scan
    firsts = [x.ref for x in ref.collect()]
    wanted = F.lit(False)
    for first in firsts:
        wanted = wanted | ((F.col("Date") >= F.lit(first)) & (F.col("Date") < F.add_months(F.lit(first), 1)))
    rows = basis.where(wanted)
    size = rows.groupBy("Sizes").agg(
        F.sum("Quantity").alias("reference_qty"), F.sum("dsp_sales").alias("reference_revenue_gross"),
        F.sum("clp_sales").alias("reference_revenue_net"), F.sum("scheme_amount").alias("reference_investment"))
    packs = cells.select("Sizes").distinct().join(size, "Sizes", "left").withColumn(
        "reference_available", F.when(F.col("reference_qty").isNull(), 0.0).otherwise(1.0)).fillna(0.0)
    packs = packs.withColumns({
        "reference_profit": F.col("reference_revenue_net") - F.col("reference_qty") * cogs,
        "reference_ml": F.col("reference_qty") * pack_ml()})
    cols = ["reference_qty", "reference_revenue_gross", "reference_revenue_net", "reference_profit", "reference_investment", "reference_ml"]
    return packs.rollup("Sizes").agg(*[F.sum(c).alias(c) for c in cols], F.max("reference_available").alias("reference_available")).fillna("TOTAL", ["Sizes"])


def cross_pack_adjust(quantities: DataFrame, reference: DataFrame, elasticity: DataFrame | None = None, mode: str = "additive") -> DataFrame:
    """Adds target_qty, the pack total each scenario should end at.

    `additive` keeps the sum of slabs; `one_pass` adds elasticity x the other pack's change against
    the reference; `solved` solves both packs' changes together."""
    if mode not in ("additive", "one_pass", "solved"):
        raise ValueError("mode must be additive, one_pass or solved")
    pack = Window.partitionBy("scenario_id", "Sizes")
    d = quantities.withColumn("pack_pre_qty", F.sum("pre_qty").over(pack))
    if mode == "additive":
        return d.withColumn("target_qty", F.greatest("pack_pre_qty", F.lit(0.0)))
    ref = reference.where("Sizes <> 'TOTAL'").select("Sizes", "reference_qty")
    e = elasticity.agg(F.struct(F.max("elasticity_12_from_18").alias("a"), F.max("elasticity_18_from_12").alias("b"))).scalar()
    d = d.join(ref, "Sizes", "left").fillna(0.0, ["reference_qty"])
    own = delta_pct("pack_pre_qty", "reference_qty")
    d = d.withColumn("own_change_pct", own)
    every = Window.partitionBy("scenario_id")
    o12 = F.coalesce(F.max(F.when(F.col("Sizes") == "12-ML", F.col("own_change_pct"))).over(every), F.lit(0.0))
    o18 = F.coalesce(F.max(F.when(F.col("Sizes") == "18-ML", F.col("own_change_pct"))).over(every), F.lit(0.0))
    e12, e18 = F.coalesce(e["a"], F.lit(0.0)), F.coalesce(e["b"], F.lit(0.0))
    both = F.when(F.col("Sizes") == "12-ML", o12 + e12 * o18).otherwise(o18 + e18 * o12)
    if mode == "solved":
        both = both / F.nullif(1 - e12 * e18, F.lit(0.0))
    d = d.withColumn("adjusted_change_pct", F.coalesce(both, F.col("own_change_pct")))
    moved = F.col("reference_qty") * (1 + F.col("adjusted_change_pct") / 100.0)
    return d.withColumn("target_qty", F.greatest(F.when(F.col("reference_qty") > 0, moved).otherwise(F.col("pack_pre_qty")), F.lit(0.0))).drop("reference_qty")


def redistribute(adjusted: DataFrame) -> DataFrame:
    """Pack targets back to slab months by their share before adjustment, else by baseline, else evenly."""
    w = Window.partitionBy("scenario_id", "Sizes")
    pre, base = F.greatest("pre_qty", F.lit(0.0)), F.greatest("baseline_qty", F.lit(0.0))
    share = F.when(F.sum(pre).over(w) > 0, pre / F.sum(pre).over(w)).when(
        F.sum(base).over(w) > 0, base / F.sum(base).over(w)).otherwise(1.0 / F.count("*").over(w))
    return adjusted.withColumn("final_qty", F.greatest(F.col("target_qty") * share, F.lit(0.0)))


def scenario_pnl(cells: DataFrame) -> DataFrame:
    """Gross and net revenue, profit and investment of baseline and scenario per cell."""
    b, q, dsp, net, cost = (F.col(c) for c in ("baseline_qty", "final_qty", "base_price", "clp_price", "cogs_per_unit"))
    extra = F.greatest(F.col("scenario_pct") - F.col("default_pct"), F.lit(0.0))
    return cells.withColumns({
        "baseline_revenue_gross": b * dsp, "scenario_revenue_gross": q * dsp, "baseline_revenue_net": b * net, "scenario_revenue_net": q * net,
        "baseline_profit": b * net - b * cost, "scenario_profit": q * net - q * cost,
        "baseline_investment": b * dsp * (F.col("default_pct") / 100.0), "scenario_investment": q * dsp * (F.col("scenario_pct") / 100.0),
        "scenario_investment_positive": q * dsp * (extra / 100.0)})


def _sums():
    return [F.sum(c).alias(c) for c in ("baseline_qty", "pre_qty", "final_qty", *MONEY)] + [
        F.sum(F.col(c) * pack_ml()).alias(n) for c, n in (("baseline_qty", "baseline_ml"), ("pre_qty", "pre_ml"), ("final_qty", "final_ml"))]


def scenario_months(pnl: DataFrame) -> DataFrame:
    """Month and pack sums with their change against the baseline."""
    g = pnl.groupBy("scenario_id", "period", "Sizes").agg(*_sums())
    return g.withColumns({
        "volume_delta_pct": delta_pct("final_qty", "baseline_qty"), "revenue_delta_pct": delta_pct("scenario_revenue_gross", "baseline_revenue_gross"),
        "profit_delta_pct": delta_pct_abs("scenario_profit", "baseline_profit"), "investment_delta_pct": delta_pct("scenario_investment", "baseline_investment")})


def scenario_summary(pnl: DataFrame, reference: DataFrame) -> DataFrame:
    """Whole-horizon sums per pack and TOTAL against baseline and reference."""
    g = pnl.groupingSets([["scenario_id", "Sizes"], ["scenario_id"]], "scenario_id", "Sizes").agg(*_sums())
    g = g.fillna("TOTAL", ["Sizes"]).join(reference, "Sizes", "left")
    return g.withColumns({
        "discount_component_qty": F.col("pre_qty") - F.col("baseline_qty"),
        "volume_delta_pct": delta_pct("final_qty", "baseline_qty"), "volume_delta_additive_pct": delta_pct("pre_qty", "baseline_qty"),
        "volume_ml_delta_pct": delta_pct("final_ml", "baseline_ml"),
        "revenue_gross_delta_pct": delta_pct("scenario_revenue_gross", "baseline_revenue_gross"),
        "revenue_net_delta_pct": delta_pct("scenario_revenue_net", "baseline_revenue_net"),
        "profit_delta_pct": delta_pct_abs("scenario_profit", "baseline_profit"),
        "investment_delta_pct": delta_pct("scenario_investment", "baseline_investment"),
        "own_delta_vs_reference_pct": delta_pct("pre_qty", "reference_qty"),
        "vs_reference_volume_pct": delta_pct("final_qty", "reference_qty"), "vs_reference_ml_pct": delta_pct("final_ml", "reference_ml"),
        "vs_reference_revenue_gross_pct": delta_pct("scenario_revenue_gross", "reference_revenue_gross"),
        "vs_reference_revenue_net_pct": delta_pct("scenario_revenue_net", "reference_revenue_net"),
        "vs_reference_profit_pct": delta_pct_abs("scenario_profit", "reference_profit"),
        "vs_reference_investment_pct": delta_pct("scenario_investment", "reference_investment"),
        "investment_positive_vs_reference_pct": delta_pct("scenario_investment_positive", "reference_investment")})


def scenario_metrics(summary: DataFrame) -> DataFrame:
    """Net margin points against the reference, cost to serve and investment percentages."""
    own, ref = (positive_ratio(f"{k}_profit", f"{k}_revenue_net", 100.0) for k in ("scenario", "reference"))
    return summary.withColumns({
        "net_margin_points": F.coalesce(own - ref, F.col("vs_reference_profit_pct")),
        "cts_pct": positive_ratio("scenario_investment", "scenario_revenue_net", 100.0),
        "investment_pct": F.when(F.col("reference_investment") > 0, F.col("vs_reference_investment_pct"))})


def score_scenarios(cells: DataFrame, months: DataFrame, reference: DataFrame, sizes: DataFrame | None = None,
                    elasticity: DataFrame | None = None, mode: str = "additive") -> DataFrame:
    """Scenario cells with final quantity and money: resolve, quantity, pack adjustment, redistribution."""
    return scenario_pnl(redistribute(cross_pack_adjust(
        scenario_quantity(resolve_scenario(cells, months, sizes)), reference, elasticity, mode)))


def scenario_thresholds(metrics: DataFrame, min_volume=None, min_pack_volume: dict | None = None, min_revenue=None,
                        min_margin=None, max_investment=None, max_cts=None) -> DataFrame:
    """TOTAL rows of the scenarios that meet every limit given. A value that is missing fails its limit."""
    per = {s: v for s, v in (min_pack_volume or {}).items() if v is not None}
    checks = [F.max(F.when(F.col("Sizes") == s, F.col("vs_reference_volume_pct"))) >= v for s, v in per.items()]
    ok = metrics.groupBy("scenario_id").agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks)]) if checks else None
    t = metrics.where("Sizes = 'TOTAL'")
    limits = [("vs_reference_ml_pct", ">=", min_volume), ("vs_reference_revenue_gross_pct", ">=", min_revenue), ("net_margin_points", ">=", min_margin),
              ("investment_pct", "<=", max_investment), ("cts_pct", "<=", max_cts)]
    for c, op, v in limits:
        if v is not None:
            t = t.where(~F.isnan(c) & ((F.col(c) >= v) if op == ">=" else (F.col(c) <= v)))
    if ok is not None:
        good = ok
        for i in range(len(checks)):
            good = good.where(F.col(f"c{i}"))
        t = t.join(good.select("scenario_id"), "scenario_id", "left_semi")
    return t


def rank_scenarios(totals: DataFrame, metric: str = "revenue") -> DataFrame:
    """`rank` from 1 by the metric, then revenue, margin and volume, all falling; ties by scenario id."""
    by = {"volume": "vs_reference_ml_pct", "profit": "net_margin_points", "revenue": "vs_reference_revenue_gross_pct"}
    cols = [by[metric], by["revenue"], by["profit"], by["volume"]]
    return ranking.numbered(totals, [*[(c, True, True) for c in dict.fromkeys(cols)], ("scenario_id", False, False)])


def cell_bounds(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scenario ids whose cells all lie inside the bounds (period, Sizes, Slab, min_pct, max_pct). A
    bounded cell a scenario lacks counts as a violation. Bounds with min above max are an error."""
    L.check_bounds(bounds)
    b = bounds.where("min_pct IS NOT NULL OR max_pct IS NOT NULL")
    n = b.agg(F.count("*")).scalar()
    good = values.join(b, ["period", "Sizes", "Slab"]).where(
        (F.col("min_pct").isNull() | (F.col("value") >= F.col("min_pct"))) & (F.col("max_pct").isNull() | (F.col("value") <= F.col("max_pct"))))
    met = good.groupBy("scenario_id").agg(F.count("*").alias("met"))
    broken = values.select("scenario_id").distinct().join(met, "scenario_id", "left").where(F.coalesce("met", F.lit(0)) < n)
    return values.select("scenario_id").distinct().join(broken, "scenario_id", "left_anti")


def coupled_response(cells: DataFrame, rounds: int = 8, tol: float = 1e-6) -> DataFrame:
    """Slab quantities whose mix feeds back into the other slabs' discount.

    `cells` is keyed by (scenario_id, Sizes, Slab). Rounds are unrolled over one partitioning; a group
    whose total change is within `tol` keeps its result. `done` tells which groups settled."""
    w = Window.partitionBy("scenario_id", "Sizes")
    d = cells.repartition("scenario_id", "Sizes").withColumns({
        "qty": F.col("anchor_qty"), "other": F.lit(0.0), "done": F.lit(False)})
    for _ in range(rounds):
        pos = F.greatest("qty", F.lit(0.0))
        d = d.withColumn("weight", F.when(F.sum(pos).over(w) > 0, pos / F.sum(pos).over(w)).otherwise(1.0 / F.count("*").over(w)))
        d = d.withColumn("__o", _other_mean("scenario_pct", ["scenario_id", "Sizes"]))
        q = F.greatest(F.col("intercept") + F.col("coef_residual") * F.col("residual_store") + F.col("coef_base") * F.col("scenario_pct")
                       + F.col("coef_lag") * F.col("last_lag") + F.col("coef_other") * F.col("__o"), F.lit(0.0))
        d = d.withColumn("__q", q).withColumn("__d", F.sum(F.abs(F.col("__q") - F.col("qty"))).over(w))
        d = d.withColumns({
            "qty": F.when(F.col("done"), F.col("qty")).otherwise(F.col("__q")), "other": F.when(F.col("done"), F.col("other")).otherwise(F.col("__o")),
            "done": F.col("done") | (F.col("__d") <= tol)})
    pos = F.greatest("qty", F.lit(0.0))
    return d.withColumn("weight", F.when(F.sum(pos).over(w) > 0, pos / F.sum(pos).over(w)).otherwise(1.0 / F.count("*").over(w))).drop("__o", "__q", "__d")


def scenario_wide(values: DataFrame, cells: list[tuple]) -> DataFrame:
    """One row per scenario with a column per (idx, size, slab) cell."""
    return values.groupBy("scenario_id").agg(*[
        F.max(F.when((F.col("idx") == i) & (F.col("Sizes") == s) & (F.col("Slab") == b), F.col("value"))).alias(f"m{i + 1}_{s}_{b}")
        for i, s, b in cells])


# Scenario generation.

def allocate_counts(weights: DataFrame, keys, total: int, weight: str = "weight", order: str = "family") -> DataFrame:
    """Splits `total` over the rows of each key by weight: one each if enough, then whole parts, then the
    largest remainders (ties to the later row)."""
    w = Window.partitionBy(*keys)
    pos = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    n = F.count("*").over(w)
    share = F.when(F.sum(pos).over(w) > 0, pos / F.sum(pos).over(w)).otherwise(1.0 / n)
    base = F.when(F.lit(total) >= n, 1).otherwise(0)
    d = weights.withColumns({"__b": base, "__raw": share * (F.lit(total) - base * n)})
    d = d.withColumn("__f", F.floor("__raw"))
    left = F.lit(total) - F.sum(F.col("__b") + F.col("__f")).over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.col("__raw") - F.col("__f")), F.desc(order)))
    return d.withColumn("allocated", (F.col("__b") + F.col("__f") + F.when(rank <= left, 1).otherwise(0)).cast("int")).drop("__b", "__raw", "__f")


def anchor_vectors(cells: DataFrame) -> DataFrame:
    """Four anchor ladders per cell from the default series: latest, shifted mean, last year's shape and a
    stress path. Columns are named after the anchors."""
    w = Window.partitionBy("Sizes", "Slab")
    d = cells.select(*CELL, "period", "default_pct").withColumns({
        "__last": F.max_by("default_pct", "idx").over(w), "__avg": F.avg("default_pct").over(w),
        "__span": F.max("default_pct").over(w) - F.min("default_pct").over(w),
        "__rank": F.dense_rank().over(Window.partitionBy("Sizes").orderBy(slab_number("Slab"), "Slab")) - 1})

    def at(*offsets):
        return F.when(F.col("idx") == 0, offsets[0]).when(F.col("idx") == 1, offsets[1]).otherwise(offsets[2])

    span = F.col("__span")
    step = F.greatest(F.lit(1.0), F.least(F.lit(2.5), F.when(span > 0, span).otherwise(1.5)))
    amp = F.greatest(F.lit(2.0), F.least(F.lit(6.0), span + 2.0))
    bias = F.when(F.col("Sizes") == "12-ML", 0.8).otherwise(-0.6) + F.when(F.col("__rank") >= 2, 0.4).otherwise(0.0)
    season = F.when(span < 1e-9, F.col("__avg") + at(F.lit(1.5), F.lit(-0.5), F.lit(1.0))).otherwise(F.col("default_pct"))
    d = d.withColumns({
        "latest_month": F.col("__last"), "last_3m_avg": F.col("__avg") + at(-step, F.lit(0.0), step), "ly_same_3m": season,
        "stress_explore": F.col("__avg") + at(-(amp + 0.5), amp * 0.5, amp + 1.0) + bias})
    for a in ANCHOR_KEYS:
        d = L.enforce_ladder(d, ["Sizes", "idx"], a)
    return d.drop("__last", "__avg", "__span", "__rank")


def uniform(seed: int, *parts) -> Column:
    """A draw in [0, 1) that depends on its key alone, so any partitioning gives the same rows: the first 52 bits of the md5 of the
    parts joined by `|`. Any SQL engine with md5 draws the same number."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(2**52)


def _whole(seed: int, low: Column, high: Column, *parts) -> Column:
    return low + F.floor(uniform(seed, *parts) * (high - low + 1))


def month_shift(pattern: Column, idx: Column, strength: Column) -> Column:
    r = F.pmod(idx, F.lit(3))
    return (F.when(pattern == "up", idx * strength).when(pattern == "down", -idx * strength)
            .when(pattern == "wave", F.when(r == 1, strength).when(r == 2, -strength).otherwise(0))
            .when(pattern == "pulse", F.when(r == 1, 0).otherwise(strength)).otherwise(0))


def _of_anchor(anchor: Column, cell: Column) -> Column:
    out = cell[ANCHOR_KEYS[-1]]
    for a in ANCHOR_KEYS[:-1]:
        out = F.when(anchor == a, cell[a]).otherwise(out)
    return out


def _held(x: Column) -> Column:
    return F.greatest(F.lit(float(LADDER_MIN)), F.least(F.lit(float(LADDER_MAX)), x))


def packed_anchors(anchors: DataFrame) -> Column:
    """The anchor cells as one array in the order of size, month and slab. A plan has some tens of cells, so the array is small."""
    n = slab_number("Slab").alias("n")
    return anchors.agg(F.array_sort(F.collect_list(F.struct("Sizes", "idx", n, "Slab", "period", *ANCHOR_KEYS)))).scalar()


def draw_scenarios(families: DataFrame, anchors: DataFrame, seed: int, first: int = 0, last: int = 4) -> DataFrame:
    """Candidates (plan, family, candidate, anchor, cells, drawn): for every family the candidates numbered from `first` to
    `last` times `allocated`, each an anchor moved by the family's pattern, noise and gaps. `cells` are the anchor
    cells in their order and `drawn` the candidate's values at them. A draw depends on the plan, family and number
    alone. Numbers are dealt out before anything is drawn; a candidate is one row, and its draws need no shuffle."""
    ids = families.where("allocated > 0").select("*", F.explode(F.sequence(F.col("allocated") * first, F.col("allocated") * last - 1)).alias("candidate"))
    # by number, since the few bytes of the ids would be joined into one task
    ids = ids.repartition(int(families.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DRAWN)
    cand = [F.col("plan"), F.col("family"), F.col("candidate")]
    d = ids.withColumn("__u", uniform(seed, F.lit("anchor"), *cand)).withColumn("cells", packed_anchors(anchors))
    run, pick, cuts = F.lit(0.0), F.lit(ANCHOR_KEYS[-1]), []
    for a in ANCHOR_KEYS:
        run = run + F.col("anchor_weights")[a]
        cuts.append((run, a))
    for c, a in reversed(cuts):
        pick = F.when(F.col("__u") <= c, a).otherwise(pick)
    d = d.withColumn("anchor", pick)
    d = d.withColumn("__a", F.transform("cells", lambda c: F.struct(c["Sizes"].alias("Sizes"), c["idx"].alias("idx"), c["Slab"].alias("Slab"), _of_anchor(F.col("anchor"), c).alias("a"))))
    vol = F.col("volatility")

    def part(c, i):
        """A ladder's first value, or the step to the next slab."""
        cell, before = [*cand, c["Sizes"], c["idx"]], F.get("__a", i - 1)
        noise = F.when(vol > 0, _whole(seed, -vol, vol, F.lit("noise"), *cell)).otherwise(0)
        bias = F.when(c["Sizes"] == "12-ML", F.col("size_bias_12")).otherwise(F.col("size_bias_18"))
        raw = c["a"] + bias + month_shift(F.col("month_pattern"), c["idx"], F.col("month_shift_strength")) + noise + _whole(seed, F.lit(-1), F.lit(1), F.lit("base"), *cell)
        start = _held(F.greatest(F.col("base_min"), F.least(F.col("base_max"), raw)))
        gap = F.greatest(F.lit(1.0), half_even(c["a"] - before["a"])) + _whole(seed, F.lit(-1), F.lit(1), F.lit("gap"), *cell, c["Slab"])
        gap = F.greatest(F.col("gap_min"), F.least(F.col("gap_max"), gap))
        first = ~(before["Sizes"].eqNullSafe(c["Sizes"]) & before["idx"].eqNullSafe(c["idx"])) | (i == 0)
        return F.struct(first.alias("first"), F.when(first, start).otherwise(gap).cast("double").alias("part"))

    state = "struct<run double, top double, out array<double>>"
    empty = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("top"), F.array().alias("out")).cast(state)

    def step(s, p):
        run = F.when(p["first"], p["part"]).otherwise(s["run"] + p["part"])
        top = F.when(p["first"], _held(run)).otherwise(F.greatest(s["top"], _held(run)))
        return F.struct(run.alias("run"), top.alias("top"), F.concat(s["out"], F.array(F.round(top, 2))).alias("out"))

    d = d.withColumn("__p", F.transform("__a", part))
    return d.select(*DRAWN, "anchor", "cells", F.aggregate("__p", empty, step, lambda s: s["out"]).alias("drawn"))


def _cells(packed: DataFrame, *keys: str) -> DataFrame:
    """A row for every cell of packed candidates, with `value`."""
    each = packed.select(*keys, F.explode(F.arrays_zip("cells", "drawn")).alias("c"))
    return each.select(*keys, "c.cells.Sizes", "c.cells.Slab", "c.cells.idx", "c.cells.period", F.col("c.drawn").alias("value"))


def _bounded(packed: DataFrame, bounds: DataFrame) -> DataFrame:
    """Packed candidates inside the bounds; one whose bounds cross in any ladder goes."""
    rows = L.enforce_bounded(_cells(packed, *DRAWN, "anchor").join(bounds, ["period", "Sizes", "Slab"], "left"), [*DRAWN, "Sizes", "idx"])
    value = F.struct("Sizes", "idx", slab_number("Slab").alias("n"), "Slab", "value")
    held = rows.groupBy(*DRAWN).agg(F.array_sort(F.collect_list(value)).alias("held"), F.bool_or(F.col("value").isNull()).alias("broken")).where("NOT broken")
    return packed.join(held, DRAWN).withColumn("drawn", F.col("held.value")).drop("held", "broken")


def _lively(packed: DataFrame) -> DataFrame:
    """Packed candidates of whole points that are neither nearly flat, nor tiny, nor equal in all months."""
    v = F.col("drawn")
    months = F.array_distinct(F.col("cells.idx"))
    shapes = F.array_distinct(F.transform(months, lambda m: F.filter(v, lambda x, i: F.get("cells", i)["idx"] == m)))
    return packed.where((F.size(F.array_distinct(v)) > 2) & (F.array_max(v) > 6) & (F.array_max(v) - F.array_min(v) > 2) & (F.size(shapes) > 1))


def drop_degenerate(values: DataFrame, key="scenario_id", decimals: int = 2, within=()) -> DataFrame:
    """Drops scenarios that are nearly flat, tiny or equal in all months, and later copies of an earlier
    one. Copies meet in an aggregation that keeps only the lowest id; `within` names the key columns inside
    which copies count, all scenarios together by default."""
    keys = [key] if isinstance(key, str) else list(key)
    month = values.groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(F.struct("Sizes", "Slab", F.round("value", decimals).alias("v")))).alias("cells"))
    whole = F.flatten(F.collect_list(F.transform("cells", lambda c: F.rint(c["v"]))))
    s = month.groupBy(*keys).agg(
        whole.alias("v"), F.count_distinct(F.transform("cells", lambda c: F.rint(c["v"]))).alias("shapes"),
        F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("idx", "cells"))))).alias("signature"))
    live = s.where((F.size(F.array_distinct("v")) > 2) & (F.array_max("v") > 6) & (F.array_max("v") - F.array_min("v") > 2) & (F.col("shapes") > 1))
    first = live.groupBy(*within, "signature").agg(F.min(F.struct(*keys)).alias("k")).select(*[F.col(f"k.{k}").alias(k) for k in keys])
    return values.join(first, keys, "left_semi")


def _ranked(rows: DataFrame, keys, order: str, block: int = 512) -> DataFrame:
    """`rank` from 1 by the whole number `order` inside every key. Blocks of numbers are counted first, so no window
    holds more than a block."""
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order))
    return rows.join(counts.drop("__n"), [*keys, "__block"]).withColumn("rank", F.col("__before") + own).drop("__block", "__before")


#: Candidates of a family are drawn up to these multiples of the number asked for.
ROUNDS = (4, 16, 100)


def generate_scenarios(families: DataFrame, cells: DataFrame, seed: int = 7, bounds: DataFrame | None = None) -> DataFrame:
    """Scenario cells (plan, scenario_id, family, anchor, idx, period, Sizes, Slab, value) in whole points, inside the bounds, without
    degenerate scenarios and without two equal ones in a plan; `families` (plan, family, ..., allocated) carries how many
    each family should give.

    Candidates are drawn in rounds, up to a hundred times the number asked for, until every plan has enough; of equal candidates the
    first round's, then the lowest number stays. What a family lacks then comes from the plan's other families. A plan
    that still falls short raises ValueError. A candidate is one row with its values in an array; new candidates are
    held against the signatures kept so far, and only chosen ones become cells."""
    families = cut(families)
    anchors = cut(anchor_vectors(cells))
    if bounds is not None:
        L.check_bounds(bounds)
    kept, first = None, 0
    wanted = families.groupBy("plan").agg(F.sum("allocated").alias("wanted"))
    for last in ROUNDS:
        draws = draw_scenarios(families, anchors, seed, first, last)
        draws = _bounded(draws, bounds) if bounds is not None else draws.withColumn("drawn", F.transform("drawn", lambda x: L.in_range(F.rint(x))))
        draws = draws.withColumn("signature", F.array_join(F.transform("drawn", lambda x: x.cast("string")), ","))
        new = draws.groupBy("plan", "signature").agg(F.min(F.struct("candidate", "family", "anchor", "drawn")).alias("k"))
        new = _lively(new.select("plan", "k.family", "k.candidate", "k.anchor", "k.drawn", "signature").withColumn("cells", packed_anchors(anchors))).drop("cells")
        kept = cut(new if kept is None else kept.unionByName(new.join(kept, ["plan", "signature"], "left_anti")))
        have = kept.groupBy("plan").agg(F.count("*").alias("have"))
        short = wanted.join(have, "plan", "left").where(F.coalesce("have", F.lit(0)) < F.col("wanted")).orderBy("plan").limit(20).collect()
        if not short:
            break
        first = last
    if short:
        raise ValueError("too few distinct scenarios: " + ", ".join(f"{r.plan} has {r.have or 0} of {r.wanted}" for r in short))
    ids = _ranked(kept.select(*DRAWN), ["plan", "family"], "candidate").join(families.select("plan", "family", "allocated"), ["plan", "family"])
    own, spare = ids.where("rank <= allocated"), ids.where("rank > allocated")
    lack = wanted.join(own.groupBy("plan").agg(F.count("*").alias("have")), "plan", "left").select("plan", (F.col("wanted") - F.coalesce("have", F.lit(0))).alias("lack")).where("lack > 0")
    spare = _ranked(spare.drop("rank").withColumn("__turn", F.col("candidate") * F.lit(1000) + F.col("family")), ["plan"], "__turn", 512_000).join(lack, "plan").where(F.col("rank") <= F.col("lack"))
    chosen = own.select(*DRAWN).unionByName(spare.select(*DRAWN)).withColumn("scenario_id", F.format_string("%s-f%d-%06d", "plan", "family", "candidate"))
    out = kept.join(chosen, DRAWN).withColumn("cells", packed_anchors(anchors))
    return _cells(out, "plan", "scenario_id", "family", "anchor")
