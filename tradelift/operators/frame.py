"""The month table each model is fitted on, for all sizes and slabs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradelift.functions.columns import month_of, positive_ratio, ratio, slab_number
from tradelift.operators import discount as D, ranking, sequence as Q
from tradelift.schema import BaseParams

GROUP = ["Sizes", "Slab"]


def slab_order(df: DataFrame, slab: str = "Slab") -> DataFrame:
    """Adds the position of each slab when ordered by the number in its text."""
    keyed = df.withColumns({"__number": F.coalesce(slab_number(slab), F.lit(2**31 - 1)), "__text": F.lower(slab)})
    return ranking.numbered(keyed, [("__number", False, False), ("__text", False, False)], "position").drop("__number", "__text")


def month_totals(outlet_days: DataFrame, keys=GROUP, discount="scheme_amount", sales="dsp_sales") -> DataFrame:
    """Outlets and sums per key and month. Outlets are counted by a first grouping on the outlet."""
    extra = [c for c in ("mrp_qty", "clp_sales") if c in outlet_days.columns]
    names = {"Quantity": "quantity", discount: "total_discount", sales: "sales_value"} | {c: c for c in extra}
    per = outlet_days.groupBy(*keys, "Outlet_ID", month_of("Date").alias("period")).agg(
        *[F.sum(c).alias(n) for c, n in names.items()])
    m = per.groupBy(*keys, "period").agg(
        F.count("Outlet_ID").alias("store_count"), *[F.sum(n).alias(n) for n in names.values()])
    return m.withColumn("actual_discount_pct", ratio("total_discount", "sales_value", 100.0, 0.0))


def month_model_frame(outlet_days: DataFrame, keys=GROUP, p: BaseParams = BaseParams(),
                      discount="scheme_amount", sales="dsp_sales") -> DataFrame:
    """Outlets, quantity, discount parts, lagged base and base price per key and month."""
    keys = list(keys)
    months = month_totals(outlet_days, keys, discount, sales)
    if p.mode == "define":
        m = D.month_base(months, keys, p)
    else:
        days = outlet_days.groupBy(*keys, F.col("Date").alias("period")).agg(
            (F.coalesce(ratio(F.sum(discount), F.sum(sales), 100.0), F.lit(0.0))).alias("actual_discount_pct"))
        m = D.base_to_month(months, D.block_base(days, keys, p), keys)
    m = m.withColumns({
        "tactical_discount_pct": F.greatest(F.col("actual_discount_pct") - F.col("base_discount_pct"), F.lit(0.0)),
        "base_price": ratio("sales_value", "quantity", 1.0, 0.0)})
    return Q.lag_base(m, keys, "period")


def other_slabs_discount(months: DataFrame, size_keys=("Sizes",), slab: str = "Slab") -> DataFrame:
    """Adds the other slabs' base discount of the month, weighted by their whole-period quantity.

    A slab missing in a month is not made up for. Everything comes from sums over the size minus
    the slab's own part, so no slab is joined to its siblings."""
    size, own = list(size_keys), [*size_keys, slab]
    q = F.coalesce("quantity", F.lit(0.0))
    d = months.withColumns({
        "__q": F.sum(q).over(Window.partitionBy(*own)),
        "__all": F.sum(q).over(Window.partitionBy(*size)),
        "__slabs": F.size(F.collect_set(slab).over(Window.partitionBy(*size))),
    })
    same_month = Window.partitionBy(*size, "period")
    b = F.coalesce("base_discount_pct", F.lit(0.0))
    d = d.withColumns({
        "__w": F.sum(F.col("__q") * b).over(same_month) - F.col("__q") * b,
        "__e": F.sum(b).over(same_month) - b,
        "__k": F.count("*").over(same_month),
    })
    rest = F.col("__all") - F.col("__q")
    value = F.when(F.col("__k") < 2, None).when(rest > 0, F.col("__w") / rest).otherwise(
        F.col("__e") / F.nullif(F.col("__slabs") - 1, F.lit(0)))
    name = "other_slabs_weighted_base_discount_pct"
    d = d.withColumn(name, value).drop("__q", "__all", "__slabs", "__w", "__e", "__k")
    return Q.fill_gaps(d, own, "period", [name]).fillna(0.0, [name])


def slab_weights(df: DataFrame, keys=("Sizes",)) -> DataFrame:
    """Quantity share per slab; without any quantity the latest month's mix, else equal shares."""
    months = df.groupBy(*keys, "Slab", month_of("Date").alias("period")).agg(F.sum("Quantity").alias("q"))
    last = F.max("period").over(Window.partitionBy(*keys))
    slabs = months.withColumn("__last", last).groupBy(*keys, "Slab").agg(
        F.sum("q").alias("q"), F.sum(F.when(F.col("period") == F.col("__last"), F.col("q"))).alias("l"))
    w = Window.partitionBy(*keys)

    def share(c):
        v = F.when(F.sum(c).over(w) > 0, F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)))
        return v

    s = slabs.withColumns({"__m": share("q"), "__f": share("l")})
    modeled = positive_ratio("__m", F.sum("__m").over(w))
    latest = positive_ratio("__f", F.sum("__f").over(w))
    return s.select(
        *keys, "Slab", F.coalesce(modeled, latest, 1.0 / F.count("*").over(w)).alias("weight"),
        F.when(modeled.isNotNull(), "modeled").otherwise("fallback_latest_mix").alias("weight_source"))


def base_discount_table(outlet_days: DataFrame, keys=GROUP, p: BaseParams = BaseParams()) -> DataFrame:
    """Month table on the total-discount basis: quantity, actual and estimated base percentage."""
    m = month_totals(outlet_days, keys, "TotalDiscount", "SalesValue_atBasicRate")
    m = m.withColumn("actual_discount_pct", positive_ratio("total_discount", "sales_value", 100.0))
    b = D.month_base(m, keys, p)
    return b.withColumns({c: F.round(c, 2) for c in ("actual_discount_pct", "base_discount_pct")})


def _fixed_weight(base: DataFrame, size_keys) -> DataFrame:
    q = F.coalesce("quantity", F.lit(0.0))
    slab_q = F.sum(q).over(Window.partitionBy(*size_keys, "Slab"))
    w = Window.partitionBy(*size_keys)
    n = F.size(F.collect_set("Slab").over(w))
    return base.withColumn("fixed_weight", F.coalesce(positive_ratio(slab_q, F.sum(q).over(w)), 1.0 / n))


def weighted_discount_detail(base: DataFrame, size_keys=("Sizes",)) -> DataFrame:
    """Slab months with their fixed whole-period weight, weighted parts and the month's totals."""
    d = _fixed_weight(base, size_keys).withColumns({
        "weighted_base": F.col("fixed_weight") * F.coalesce("base_discount_pct", F.lit(0.0)),
        "weighted_actual": F.col("fixed_weight") * F.coalesce("actual_discount_pct", F.lit(0.0))})
    m = Window.partitionBy(*size_keys, "period")
    return d.withColumns({"month_base": F.sum("weighted_base").over(m), "month_actual": F.sum("weighted_actual").over(m)})


def base_summary(base: DataFrame, size_keys=("Sizes",)) -> DataFrame:
    s = base.groupBy(*size_keys, "Slab").agg(
        F.count_distinct("period").alias("months"), F.round(F.avg("actual_discount_pct"), 2).alias("avg_actual"),
        F.round(F.avg("base_discount_pct"), 2).alias("avg_base"), F.sum("quantity").alias("quantity"))
    return s.withColumn("quantity_pct", F.round(
        positive_ratio("quantity", F.sum("quantity").over(Window.partitionBy(*size_keys)), 100.0), 2))


def size_month_frame(outlet_days: DataFrame, size_keys=("Sizes",), p: BaseParams = BaseParams()) -> DataFrame:
    """All slabs of a pack as one series: total-discount basis, fixed-weight base, weighted MRP."""
    size = list(size_keys)
    base = base_discount_table(outlet_days, [*size, "Slab"], p)
    month = weighted_discount_detail(base, size).groupBy(*size, "period").agg(
        F.sum("weighted_base").alias("base_discount_pct"))
    m = month_totals(outlet_days, size, "TotalDiscount", "SalesValue_atBasicRate")
    m = m.withColumn("actual_discount_pct", positive_ratio("total_discount", "sales_value", 100.0, 0.0))
    m = D.base_to_month(m, month, size)
    mrp = positive_ratio("mrp_qty", "quantity") if "mrp_qty" in m.columns else positive_ratio("sales_value", "quantity")
    m = Q.fill_gaps(m.withColumn("mrp_weighted", mrp), size, "period", ["mrp_weighted"])
    m = m.fillna(0.0, ["mrp_weighted"]).withColumns({
        "tactical_discount_pct": F.greatest(F.col("actual_discount_pct") - F.col("base_discount_pct"), F.lit(0.0)),
        "base_price": ratio("sales_value", "quantity", 1.0, 0.0)})
    return Q.lag_base(m, size, "period")


def month_metrics(df: DataFrame, by=(), p: BaseParams = BaseParams()) -> DataFrame:
    """Month sales, volume, discount, base, price and growth, overall or per column."""
    by = list(by)
    m = df.groupBy(*by, month_of("Date").alias("period")).agg(
        F.sum("SalesValue_atBasicRate").alias("sales"), F.sum("Quantity").alias("volume"),
        F.sum("TotalDiscount").alias("discount"), F.sum(F.col("MRP") * F.col("Quantity")).alias("mrp_x_vol"))
    m = m.withColumn("discount_level_pct", ratio("discount", "sales", 100.0))
    m = D.month_base(m, by, p, "discount_level_pct")
    m = m.withColumns({"base_price": ratio("sales", "volume"), "mrp": ratio("mrp_x_vol", "volume")}).drop("mrp_x_vol")
    return Q.pct_change(m, by, "period", {"sales": "sales_growth_pct", "volume": "volume_growth_pct"}, fill=None)
