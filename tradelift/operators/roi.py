"""Return on structural (base step-up) and tactical (above-base) discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradelift.functions.columns import norm_size, ratio
from tradelift.operators import sequence as Q
from tradelift.operators.fit import OTHER, predict_quantity
from tradelift.schema import COGS_DEFAULTS, ModelParams


def resolve_cogs(size, p: ModelParams = ModelParams(), default=None):
    """Unit cost: per-size value, then the single value, then the size's own default, then `default`.
    A value of zero or less falls back to the size's default."""
    s = norm_size(size)
    own = F.lit(None).cast("double")
    for k, v in COGS_DEFAULTS.items():
        own = F.when(s == k, v).otherwise(own)

    def usable(v: float):
        return F.lit(float(v)) if v > 0 else F.coalesce(own, F.lit(max(float(v), 0.0)))

    last = F.coalesce(own, F.greatest(F.coalesce(default if default is not None else F.lit(0.0), F.lit(0.0)), F.lit(0.0)))
    out = last if p.cogs_per_unit is None else usable(p.cogs_per_unit)
    for k, v in p.cogs_per_size.items():
        out = F.when(s == k.upper().replace(" ", ""), usable(v)).otherwise(out)
    return out


def default_cogs(df: DataFrame, keys, order="period", price="base_price"):
    """Half the first price, rounded half-even."""
    return F.rint(F.first(price, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * 0.5)


def hold_months(model_rows: DataFrame, keys, coefs, cogs, round_step: float = 0.5, include_other: bool = False,
                order="period", floor: bool = True) -> DataFrame:
    """Months of every step-up regime with both worlds: the old base held, and the new base.

    The lag of the new world is the old base in the first month. Both worlds are valued at the old
    net price; spend is price x step x new quantity."""
    d = Q.regimes(model_rows, keys, order, "base_discount_pct", round_step).where("level > prev_level")
    old, new = F.col("prev_level"), F.col("level")
    shared = {"residual_store": F.col("residual_store")} | ({OTHER: F.col(OTHER)} if include_other else {})

    def world(level, lag):
        q = predict_quantity(coefs, shared | {"base_discount_pct": level, "lag1_base_discount_pct": lag})
        return F.greatest(q, F.lit(0.0)) if floor else q

    d = d.withColumns({
        "step_up": new - old, "lag_new": F.when(F.col("hold_idx") == 1, old).otherwise(new),
        "cogs_per_unit": cogs, "old_price": F.col("base_price") * (1 - old / 100.0)})
    d = d.withColumns({"qty_old": world(old, old), "qty_new": world(new, F.col("lag_new"))})
    more = F.col("qty_new") - F.col("qty_old")
    return d.withColumns({
        "spend": F.col("base_price") * (F.col("step_up") / 100.0) * F.col("qty_new"),
        "incremental_revenue": more * F.col("old_price"),
        "incremental_profit": more * F.col("old_price") - F.col("cogs_per_unit") * more})


def structural_episodes(holds: DataFrame, keys, order="period") -> DataFrame:
    first = {c: F.min_by(c, order) for c in ("quantity", "qty_new", "actual_discount_pct")}
    e = holds.groupBy(*keys, "regime_id").agg(
        F.min(order).alias("start_period"), F.max(order).alias("end_period"), F.count("*").alias("hold_months"),
        F.first("prev_level").alias("prev_base"), F.first("level").alias("new_base"),
        first["quantity"].alias("actual_quantity"), first["qty_new"].alias("predicted_quantity"),
        first["actual_discount_pct"].alias("actual_discount_pct"),
        *[F.sum(c).alias(c) for c in ("spend", "incremental_revenue", "incremental_profit")])
    paid = F.col("spend") > 0
    return e.withColumns({
        "roi_1mo": F.when(paid, F.col("incremental_revenue") / F.col("spend")),
        "profit_roi_1mo": F.when(paid, F.col("incremental_profit") / F.col("spend"))})


def structural_roi(model_rows: DataFrame, keys, coefs, cogs, p: ModelParams = ModelParams()) -> DataFrame:
    return structural_episodes(hold_months(model_rows, keys, coefs, cogs, p.round_step, p.include_other_slabs), keys)


def roi_summary(episodes: DataFrame, keys) -> DataFrame:
    s = episodes.groupBy(*keys).agg(
        F.count("*").alias("episodes"), F.avg("roi_1mo").alias("avg_roi_1mo"), F.avg("profit_roi_1mo").alias("avg_profit_roi_1mo"),
        F.sum("spend").alias("total_spend"), F.sum("incremental_revenue").alias("total_incremental_revenue"),
        F.sum("incremental_profit").alias("total_incremental_profit"))
    paid = F.col("total_spend") > 0
    return s.withColumns({
        "structural_roi_1mo": F.when(paid, F.col("total_incremental_revenue") / F.col("total_spend")).otherwise(0.0),
        "structural_profit_roi_1mo": F.when(paid, F.col("total_incremental_profit") / F.col("total_spend")).otherwise(0.0)})


def combined_roi(summary: DataFrame, quality: DataFrame, keys=("Sizes", "Slab")) -> DataFrame:
    """Per size and overall: spend, increments, ROI and quantity-weighted R2. `quality` holds one row
    per slab with its quantity and r2; slabs without an episode count with zero spend."""
    j = quality.join(summary, list(keys), "left")
    paid = F.sum("total_spend") > 0
    g = j.groupingSets([["Sizes"], []], "Sizes").agg(
        F.count("*").alias("slabs"), F.coalesce(F.sum("total_spend"), F.lit(0.0)).alias("total_spend"),
        F.coalesce(F.sum("total_incremental_revenue"), F.lit(0.0)).alias("total_incremental_revenue"),
        F.coalesce(F.sum("total_incremental_profit"), F.lit(0.0)).alias("total_incremental_profit"),
        F.coalesce(F.when(paid, F.sum("total_incremental_revenue") / F.sum("total_spend")), F.lit(0.0)).alias("combined_roi_1mo"),
        F.coalesce(F.when(paid, F.sum("total_incremental_profit") / F.sum("total_spend")), F.lit(0.0)).alias("combined_profit_roi_1mo"),
        F.when(F.sum("quantity") > 0, F.sum(F.col("quantity") * F.col("r2")) / F.sum("quantity")).otherwise(0.0).alias("weighted_r2"))
    return g.withColumn("Sizes", F.coalesce("Sizes", F.lit("TOTAL")))


def profit_roi(rows: DataFrame, cogs, new="qty_new", old="qty_old") -> DataFrame:
    """ROI after unit cost for rows carrying both quantities, revenue increment and spend."""
    inc = F.col("incremental_revenue") - cogs * (F.col(new) - F.col(old))
    return rows.withColumns({"incremental_profit": inc, "profit_roi": ratio(inc, F.col("spend"))})


def tactical_roi(model_rows: DataFrame, keys, min_pp: float = 0.5) -> DataFrame:
    """Months whose discount exceeds the base by more than `min_pp`: lift, break-even lift and ROI."""
    d = model_rows.where(F.col("tactical_discount_pct") > float(min_pp))
    actual = 1 - F.col("actual_discount_pct") / 100.0
    base = 1 - F.col("base_discount_pct") / 100.0
    d = d.withColumns({
        "qty_lift_pct": (ratio("predicted_quantity", "baseline_quantity") - 1) * 100.0,
        "breakeven_qty_lift_pct": (base / F.nullif(actual, F.lit(0.0)) - 1) * 100.0,
        "roi_1mo": ratio("incremental_revenue", "spend")})
    return d.withColumn("lift_minus_breakeven_pct", F.col("qty_lift_pct") - F.col("breakeven_qty_lift_pct"))


def roi_by_month(holds: DataFrame, keys, order="period") -> DataFrame:
    """Every hold month with the ROI of its episode, averaged per month."""
    w = Window.partitionBy(*keys, "regime_id")
    roi = F.when(F.sum("spend").over(w) > 0, F.sum("incremental_revenue").over(w) / F.sum("spend").over(w))
    return holds.withColumn("__r", roi).groupBy(*keys, order).agg(F.avg("__r").alias("roi_1mo"))


def episode_breakdown(holds: DataFrame) -> DataFrame:
    """The parts of both worlds' quantity and the money per hold month."""
    b, lag = F.col("coef_base_discount_pct"), F.col("coef_lag1_base_discount_pct")
    return holds.withColumns({
        "part_residual": F.col("coef_residual_store") * F.col("residual_store"),
        "part_base_old": b * F.col("prev_level"), "part_base_new": b * F.col("level"),
        "part_lag_old": lag * F.col("prev_level"), "part_lag_new": lag * F.col("lag_new"),
        "new_price": F.col("base_price") * (1 - F.col("level") / 100.0)})


def roi_timeline(model_rows: DataFrame, episodes: DataFrame, keys, order="period") -> DataFrame:
    """Predicted and actual months with the ROI of an episode starting there, if any."""
    e = episodes.select(*keys, F.col("start_period").alias(order), F.col("roi_1mo").alias("episode_roi_1mo"),
                        F.col("profit_roi_1mo").alias("episode_profit_roi_1mo"), F.col("spend").alias("episode_spend"))
    return model_rows.join(e, [*keys, order], "left")
