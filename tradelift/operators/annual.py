"""Twelve-month plans: default path, planned paths, money and episode ROI for all slabs and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradelift.functions.columns import clip, ratio, round_step, slab_index
from tradelift.operators import sequence as Q
from tradelift.operators.fit import predict_quantity

FEATURES = ["residual_store", "base_discount_pct", "tactical_discount_pct", "lag1_base_discount_pct"]

# Default discount per size, fiscal month (April first) and slab 1 to 4.
DEFAULT_GRID = {
    "18-ML": [
        (12, 15, 17, 17), (13, 17, 19, 19), (12, 15, 17, 17), (12, 15, 17, 17), (12, 15, 17, 17), (13, 17, 19, 19),
        (12, 15, 17, 17), (13, 17, 19, 19), (12, 15, 17, 17), (12, 15, 17, 17), (12, 15, 17, 17), (12, 15, 17, 17),
    ],
    "12-ML": [
        (18, 24, 25, 25), (14, 17, 18, 18), (14, 17, 18, 18), (17, 21, 18, 22), (14, 17, 18, 18), (18, 24, 24, 25),
        (14, 17, 18, 18), (14, 17, 18, 18), (14, 17, 18, 18), (14, 17, 18, 18), (14, 17, 18, 18), (14, 17, 18, 18),
    ],
}


def default_grid(spark: SparkSession) -> DataFrame:
    """The fixed grid as rows (Sizes, plan_idx, slab_no, grid_pct)."""
    rows = [(s, i, k + 1, float(v)) for s, months in DEFAULT_GRID.items() for i, m in enumerate(months) for k, v in enumerate(m)]
    return spark.createDataFrame(rows, "Sizes string, plan_idx int, slab_no int, grid_pct double")


def plan_spine(model_rows: DataFrame, keys, start_year: int | None = None) -> DataFrame:
    """Twelve Apr-Mar months per key with the model row of each month, if any. Without a year the
    plan starts in the fiscal year of the key's last month."""
    keys = list(keys)
    last = F.max("period")
    year = F.lit(start_year) if start_year is not None else F.year(last) - F.when(F.month(last) >= 4, 0).otherwise(1)
    g = model_rows.groupBy(*keys).agg(F.make_date(year, F.lit(4), F.lit(1)).alias("plan_start"),
                                      F.max_by("base_price", "period").alias("last_price"))
    months = g.select("*", F.posexplode(F.sequence("plan_start", F.add_months("plan_start", 11), F.expr("interval 1 month"))).alias("plan_idx", "period"))
    return months.join(model_rows.select(
        *keys, "period", "base_price", "actual_discount_pct", "store_count", "residual_store", "base_discount_pct"), [*keys, "period"], "left")


def grid_lookup(spine: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds grid_pct for the size, month and slab number, where the grid has one."""
    return spine.withColumn("slab_no", slab_index("Slab")).join(grid, ["Sizes", "plan_idx", "slab_no"], "left").drop("slab_no")


def default_path(model_rows: DataFrame, coefs: DataFrame, keys, start_year=None, grid: DataFrame | None = None,
                 step: float = 0.5) -> DataFrame:
    """Per key twelve months with residual, price, the default discount and the base before the plan.

    The default is the grid, else last year's base when all twelve months are known, else the
    observed base moved on by a month."""
    keys = list(keys)
    d = plan_spine(model_rows, keys, start_year)
    d = Q.fill_gaps(d, keys, "plan_idx", ["base_discount_pct"]).fillna(0.0, ["base_discount_pct"])
    d = d.join(coefs, keys)
    hist = model_rows.select(*keys, F.add_months("period", 12).alias("period"), F.col("base_discount_pct").alias("ly_base"))
    before = model_rows.select(*keys, F.add_months("period", 1).alias("plan_start"), F.col("base_discount_pct").alias("before_base"))
    d = d.join(hist, [*keys, "period"], "left").join(before, [*keys, "plan_start"], "left")
    if grid is not None:
        d = grid_lookup(d, grid)
    w, all_ = Window.partitionBy(*keys).orderBy("plan_idx"), Window.partitionBy(*keys)
    d = d.withColumn("observed", round_step("base_discount_pct", step))
    price = F.coalesce("base_price", F.rint(F.col("last_price") * 2) / 2)
    pred_store = F.col("stage1_intercept") + F.col("stage1_coef_discount") * F.coalesce("actual_discount_pct", "observed")
    d = d.withColumns({
        "price": price, "residual_store": F.coalesce("residual_store", F.coalesce("store_count", F.lit(0)) - pred_store, F.lit(0.0)),
        "prev_base": round_step(F.coalesce("before_base", F.first("observed").over(w)), step),
        "__ly": F.count("ly_base").over(all_)})
    moved = F.coalesce(F.lag("observed").over(w), F.col("prev_base"))
    path = F.when(F.col("__ly") >= 12, F.col("ly_base")).otherwise(moved)
    if grid is not None:
        path = F.when(F.count("grid_pct").over(all_) >= 12, F.col("grid_pct")).otherwise(path)
    return d.withColumn("default_pct", round_step(clip(path, 0, 60), step)).withColumn(
        "cogs_default", F.rint(F.rint(F.col("last_price") * 2) / 2 * 0.5)).drop("__ly", "ly_base", "before_base", "grid_pct", "observed")


def annual_plan(path: DataFrame, plans: DataFrame | None, keys, cogs: float | None = None, step: float = 0.5) -> DataFrame:
    """Month rows per key and plan. `plans` holds (plan, plan_idx, pct[, base_price]); without it the
    default path is planned."""
    keys = list(keys)
    if plans is None:
        d = path.withColumns({"plan": F.lit("default"), "planned_pct": F.col("default_pct"), "planned_price": F.col("price")})
    else:
        own = F.col("new_price") if "base_price" in plans.columns else F.lit(None).cast("double")
        p = plans.select("plan", "plan_idx", "pct", *([F.col("base_price").alias("new_price")] if "base_price" in plans.columns else []))
        d = path.join(p, "plan_idx").withColumns({
            "planned_pct": round_step(clip("pct", 0, 60), step), "planned_price": F.coalesce(own, F.col("price"))})
    w = Window.partitionBy(*keys, "plan").orderBy("plan_idx")
    d = d.withColumns({
        "planned_price": F.rint(F.greatest("planned_price", F.lit(0.0)) * 2) / 2,
        "lag_default": F.coalesce(F.lag("default_pct").over(w), F.col("prev_base")),
        "lag_planned": F.coalesce(F.lag("planned_pct").over(w), F.col("prev_base"))})
    resid = {"residual_store": F.col("residual_store")}

    def qty(level, lag):
        return F.greatest(predict_quantity(FEATURES, resid | {
            "base_discount_pct": F.col(level), "lag1_base_discount_pct": F.col(lag)}), F.lit(0.0))

    d = d.withColumns({
        "qty_default": qty("default_pct", "lag_default"), "qty_planned": qty("planned_pct", "lag_planned"),
        "qty_zero": F.greatest(predict_quantity(FEATURES, resid), F.lit(0.0)),
        "cogs_per_unit": F.greatest(F.lit(float(cogs)) if cogs is not None else F.col("cogs_default"), F.lit(0.0)),
        "net_default": F.col("planned_price") * (1 - F.col("default_pct") / 100.0),
        "net_planned": F.col("planned_price") * (1 - F.col("planned_pct") / 100.0)})
    up = F.greatest(F.col("planned_pct") - F.col("default_pct"), F.lit(0.0))
    return d.withColumns({
        "revenue_default": F.col("qty_default") * F.col("net_default"), "revenue_planned": F.col("qty_planned") * F.col("net_planned"),
        "revenue_zero": F.col("qty_zero") * F.col("net_default"),
        "profit_default": F.col("qty_default") * (F.col("net_default") - F.col("cogs_per_unit")),
        "profit_planned": F.col("qty_planned") * (F.col("net_planned") - F.col("cogs_per_unit")),
        "spend_step": F.col("planned_price") * (up / 100.0) * F.col("qty_planned"),
        "investment_default": F.col("planned_price") * (F.col("default_pct") / 100.0) * F.col("qty_default"),
        "investment_planned": F.col("planned_price") * (F.col("planned_pct") / 100.0) * F.col("qty_planned")})


def plan_episode_roi(plan_rows: DataFrame, keys, step: float = 0.5) -> DataFrame:
    """Structural ROI of the default and of the planned path inside the year: one row per key, plan
    and world."""
    keys = [*keys, "plan"]
    both = plan_rows.select("*", F.explode(F.array(
        F.struct(F.lit("default").alias("world"), F.col("default_pct").alias("path")),
        F.struct(F.lit("planned").alias("world"), F.col("planned_pct").alias("path")))).alias("w")).select("*", "w.world", "w.path")
    d = Q.regimes(both, [*keys, "world"], "plan_idx", "path", step)
    old, new = F.col("prev_level"), F.col("level")
    resid = {"residual_store": F.col("residual_store")}

    def qty(level, lag):
        return F.greatest(predict_quantity(FEATURES, resid | {"base_discount_pct": level, "lag1_base_discount_pct": lag}), F.lit(0.0))

    lag_new = F.when(F.col("hold_idx") == 1, old).otherwise(new)
    live = F.coalesce(new > old, F.lit(False))
    more = qty(new, lag_new) - qty(old, old)
    net = F.col("planned_price") * (1 - old / 100.0)
    g = d.groupBy(*keys, "world").agg(
        F.coalesce(F.sum(F.when(live, more * net)), F.lit(0.0)).alias("incremental_revenue"),
        F.coalesce(F.sum(F.when(live, more * (net - F.col("cogs_per_unit")))), F.lit(0.0)).alias("incremental_profit"),
        F.coalesce(F.sum(F.when(live, F.col("planned_price") * ((new - old) / 100.0) * qty(new, lag_new))), F.lit(0.0)).alias("spend"))
    paid = F.col("spend") > 1e-12
    return g.withColumns({
        "roi_x": F.coalesce(F.when(paid, F.col("incremental_revenue") / F.col("spend")), F.lit(0.0)),
        "profit_roi_x": F.coalesce(F.when(paid, F.col("incremental_profit") / F.col("spend")), F.lit(0.0))})


def plan_metrics(plan_rows: DataFrame, keys, step: float = 0.5) -> DataFrame:
    """Totals, changes, spend and ROI per key and plan."""
    keys = [*keys, "plan"]
    g = plan_rows.groupBy(*keys).agg(
        *[F.sum(f"{a}_{w}").alias(f"total_{n}_{w}") for a, n in (("qty", "quantity"), ("revenue", "revenue"), ("profit", "profit")) for w in ("default", "planned")],
        F.avg("default_pct").alias("promo_default"), F.avg("planned_pct").alias("promo_planned"),
        F.sum("spend_step").alias("total_spend_plan"), F.sum("investment_default").alias("investment_default"),
        F.sum("investment_planned").alias("investment_planned"))

    def change(n):
        a, b = F.col(f"total_{n}_planned"), F.col(f"total_{n}_default")
        return F.coalesce(F.when(F.abs(b) > 1e-12, (a - b) / b * 100.0), F.lit(0.0))

    rev = F.col("total_revenue_planned") - F.col("total_revenue_default")
    prof = F.col("total_profit_planned") - F.col("total_profit_default")
    inv = F.col("investment_planned") - F.col("investment_default")
    g = g.withColumns({
        "volume_change_pct": change("quantity"), "revenue_change_pct": change("revenue"), "profit_change_pct": change("profit"),
        "promo_change_pct": F.coalesce(F.when(F.abs("promo_default") > 1e-12, (F.col("promo_planned") - F.col("promo_default")) / F.col("promo_default") * 100.0), F.lit(0.0)),
        "investment_change": inv,
        "investment_change_pct": F.coalesce(F.when(F.col("investment_default") > 1e-12, inv / F.col("investment_default") * 100.0), F.lit(0.0)),
        "roi_revenue_x": F.coalesce(F.when(F.col("total_spend_plan") > 1e-12, rev / F.col("total_spend_plan")), F.lit(0.0)),
        "profit_roi_revenue_x": F.coalesce(F.when(F.col("total_spend_plan") > 1e-12, prof / F.col("total_spend_plan")), F.lit(0.0))})
    e = plan_episode_roi(plan_rows, keys[:-1], step)
    two = e.groupBy(*keys).agg(*[
        F.max(F.when(F.col("world") == w, F.col(c))).alias(f"{n}_{w}_x") for w in ("default", "planned") for c, n in (("roi_x", "roi"), ("profit_roi_x", "profit_roi"))],
        *[F.max(F.when(F.col("world") == w, F.col("spend"))).alias(f"__s_{w}") for w in ("default", "planned")])
    both = (F.col("__s_default") > 1e-12) & (F.col("__s_planned") > 1e-12)
    return g.join(two, keys).withColumns({
        "roi_abs_change_x": F.when(both, F.col("roi_planned_x") - F.col("roi_default_x")).otherwise(0.0),
        "profit_roi_abs_change_x": F.when(both, F.col("profit_roi_planned_x") - F.col("profit_roi_default_x")).otherwise(0.0)}).drop("__s_default", "__s_planned")


def compare_plans(metrics: DataFrame) -> DataFrame:
    """Plans against the default. A path without a step-up of its own shows its ROI against the
    default path instead."""

    def shown(own, alt):
        flat = (F.abs(own) <= 1e-12) & (F.abs(alt) > 1e-12) & (F.abs(F.col("investment_change")) > 1e-12)
        return F.when(flat, alt).otherwise(own)

    m = metrics.withColumns({
        "roi_planned_x": shown(F.col("roi_planned_x"), F.col("roi_revenue_x")),
        "profit_roi_planned_x": shown(F.col("profit_roi_planned_x"), F.col("profit_roi_revenue_x"))})
    return m.withColumns({
        "roi_abs_change_x": F.col("roi_planned_x") - F.col("roi_default_x"),
        "profit_roi_abs_change_x": F.col("profit_roi_planned_x") - F.col("profit_roi_default_x")})


def plan_changes(plan_rows: DataFrame) -> DataFrame:
    """Months whose discount or price was moved."""
    d, p = F.col("planned_pct") - F.col("default_pct"), F.col("planned_price") - F.col("price")
    return plan_rows.where((F.abs(d) > 1e-9) | (F.abs(p) > 1e-9)).withColumns({
        "discount_change_pp": F.round(d, 3), "price_change": F.round(p, 3)})
