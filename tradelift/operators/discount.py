"""Discount amounts, slab and period tables, and the base depth estimator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradelift.functions.columns import fmt_g, month_of, number, period_of, positive_ratio, ratio, round_step, total
from tradelift.functions.lineage import cut
from tradelift.operators import sequence as Q, sketches
from tradelift.schema import BaseParams


def discount_basis(df: DataFrame) -> DataFrame:
    """Adds scheme_amount, dsp_sales and clp_sales per row. When both unit price columns exist and
    the preferred one is zero throughout, the other is used."""
    have = set(df.columns)
    missing = [c for c in ("Quantity", "Scheme_Discount", "Staggered_qps") if c not in have]
    first, second = "Basic_Rate_Per_PC_without_GST", "Basic_Rate_Per_PC"
    if not have & {first, second}:
        missing.append(f"{first} (or {second})")
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")

    def amount(c):
        return F.coalesce(number(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double"), F.lit(0.0))

    if first in have and second in have:
        used = F.coalesce(df.agg(F.sum(F.abs(amount(first)))).scalar(), F.lit(0.0)) > 1e-12
        dsp = F.when(used, amount(first)).otherwise(amount(second))
    else:
        dsp = amount(first if first in have else second)
    clp_col = "Selling_Rate_Per_PC_without_GST_CLP"
    clp = F.when(amount(clp_col) > 0, amount(clp_col)).otherwise(dsp) if clp_col in have else dsp
    qty = amount("Quantity")
    return df.withColumns({
        "Quantity": qty, "scheme_amount": amount("Scheme_Discount") + amount("Staggered_qps"),
        "dsp_sales": qty * dsp, "clp_sales": qty * clp})


def _entity_rollup(df: DataFrame, groups, sales: str, discount: str, lg_k: int | None = None) -> DataFrame:
    """Outlets, invoices, lines and sums per group. Counting distinct in two levels (invoice, then
    outlet) keeps every shuffle small and needs no row expansion. With `lg_k` both counts are estimates by
    sketches and the fact is aggregated once, with one row per group and task in the shuffle."""
    if lg_k is not None:
        return df.groupBy(*groups).agg(
            sketches.estimate("Outlet_ID", lg_k).alias("outlets"),
            sketches.estimate(sketches.key_of("Outlet_ID", "Bill_No", "Date"), lg_k).alias("invoices"),
            F.sum("Quantity").alias("quantity"), F.count("Quantity").alias("lines"), F.sum(sales).alias("sales_value"),
            F.sum(discount).alias("total_discount"), F.min("Quantity").alias("min_qty"), F.max("Quantity").alias("max_qty"))
    bills = df.groupBy(*groups, "Outlet_ID", "Bill_No", "Date").agg(
        F.sum("Quantity").alias("q"), F.count("Quantity").alias("lines"), F.sum(sales).alias("s"),
        F.sum(discount).alias("d"), F.min("Quantity").alias("lo"), F.max("Quantity").alias("hi"))
    outlets = bills.groupBy(*groups, "Outlet_ID").agg(
        F.count("*").alias("invoices"), *[F.sum(c).alias(c) for c in ("q", "lines", "s", "d")],
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return outlets.groupBy(*groups).agg(
        F.count("Outlet_ID").alias("outlets"), F.sum("invoices").alias("invoices"), F.sum("q").alias("quantity"),
        F.sum("lines").alias("lines"), F.sum("s").alias("sales_value"), F.sum("d").alias("total_discount"),
        F.min("lo").alias("min_qty"), F.max("hi").alias("max_qty"))


def slab_label(slab="Slab", low="min_qty", high="max_qty"):
    lo, hi = F.col(low), F.col(high)
    text = F.when(F.abs(hi - lo) < 1e-9, F.concat(F.lit("Qty="), fmt_g(lo))).otherwise(
        F.concat(F.lit("Qty "), fmt_g(lo), F.lit("-"), fmt_g(hi)))
    return F.when(lo.isNull() | hi.isNull(), F.col(slab)).otherwise(
        F.concat(F.col(slab), F.lit(" ("), text, F.lit(")")))


def _rates(df: DataFrame):
    return {
        "aoq": F.round(F.coalesce(ratio("quantity", "lines"), F.lit(0.0)), 2),
        "aov": F.round(F.coalesce(ratio("sales_value", "invoices"), F.lit(0.0)), 2),
        "discount_pct": F.round(F.coalesce(ratio("total_discount", "sales_value", 100.0), F.lit(0.0)), 2),
    }


def slab_summary(basis: DataFrame, sales="dsp_sales", discount="scheme_amount", lg_k: int | None = None) -> DataFrame:
    """Totals, rates and shares per size and slab. Outlets and invoices are exact unless `lg_k` is given (`sketches`)."""
    r = _entity_rollup(basis, ["Sizes", "Slab"], sales, discount, lg_k)
    return r.withColumns(_rates(r) | {
        "slab_label": slab_label(),
        "invoice_contribution_pct": F.round(positive_ratio("invoices", total("invoices"), 100.0, 0.0), 2),
        "sales_contribution_pct": F.round(positive_ratio("sales_value", total("sales_value"), 100.0, 0.0), 2),
    }).drop("lines")


def state_summary(df: DataFrame) -> DataFrame:
    r = _entity_rollup(df, ["Final_State"], "SalesValue_atBasicRate", "TotalDiscount")
    return r.withColumns(_rates(r)).drop("lines", "min_qty", "max_qty")


def period_rollup(df: DataFrame, grain: str = "M", keys=(), store: str = "Outlet_ID") -> DataFrame:
    """Day, week (from Monday) or month totals. Lines shrink to one per bill and store before the
    distinct counts."""
    lines = df.groupBy(*keys, period_of("Date", grain).alias("period"), "Bill_No", F.col(store).alias("__store")).agg(
        *[F.sum(c).alias(c) for c in ("Quantity", "Net_Amt", "TotalDiscount", "SalesValue_atBasicRate")])
    out = lines.groupBy(*keys, "period").agg(
        F.count_distinct("Bill_No").alias("orders"), F.count_distinct("__store").alias("store_count"),
        F.sum("Quantity").alias("quantity"), F.sum("Net_Amt").alias("net_amt"),
        F.sum("TotalDiscount").alias("total_discount"), F.sum("SalesValue_atBasicRate").alias("sales_value"))
    return out.withColumns({
        "discount_pct": ratio("total_discount", "sales_value", 100.0, 0.0),
        "base_price": ratio("sales_value", "quantity")})


def outlet_periods(df: DataFrame, grain: str = "M") -> DataFrame:
    """Period rows of every outlet plus its totals and mean discount."""
    p = period_rollup(df, grain, ["Outlet_ID"], store="Bill_No").drop("store_count", "base_price")
    w = Window.partitionBy("Outlet_ID")
    return p.withColumns({
        "discount_pct_display": round_step("discount_pct", 0.5),
        "periods": F.count("*").over(w), "outlet_quantity": F.sum("quantity").over(w),
        "outlet_net": F.sum("net_amt").over(w),
        "outlet_discount_pct": positive_ratio(F.sum("total_discount").over(w), F.sum("sales_value").over(w), 100.0, 0.0)})


def daily_discount(basis: DataFrame, keys=()) -> DataFrame:
    """Day totals and the actual discount percentage, per optional keys."""
    bills = basis.groupBy(*keys, F.col("Date").alias("period"), "Bill_No").agg(
        *[F.sum(c).alias(c) for c in ("Quantity", "scheme_amount", "dsp_sales")])
    days = bills.groupBy(*keys, "period").agg(
        F.count("Bill_No").alias("orders"), F.sum("Quantity").alias("quantity"),
        F.sum("scheme_amount").alias("total_discount"), F.sum("dsp_sales").alias("sales_value"))
    return days.withColumn("actual_discount_pct", ratio("total_discount", "sales_value", 100.0, 0.0))


def block_base(days: DataFrame, keys, p: BaseParams, value="actual_discount_pct", order="period") -> DataFrame:
    """Month base from day values: rounded, fenced, smallest segment median, then hysteresis."""
    month_keys = [*keys, "month"]
    d = days.withColumn("month", month_of(order)).withColumn("__v", round_step(value, p.round_step))
    d = Q.iqr_fence(d, month_keys, "__v", "__kept")
    cand = Q.segment_median_min(d, month_keys, order, "__kept")
    return Q.base_hysteresis(cand, list(keys), "month", "candidate", p.min_up, p.min_down)


def month_base(months: DataFrame, keys, p: BaseParams, value="actual_discount_pct", order="period") -> DataFrame:
    """Base from month values, in half points. All columns are kept."""
    d = months.withColumn("__v", round_step(value, 0.5))
    return Q.base_hysteresis(d, list(keys), order, "__v", p.min_up, p.min_down).drop("__v").withColumn(
        "base_discount_pct", round_step("base_discount_pct", 0.5))


def base_to_month(months: DataFrame, base: DataFrame, keys, order="period") -> DataFrame:
    """Month rows with their base; months without one take the base before, else the next, else 0."""
    b = base.withColumnRenamed("month", order) if order not in base.columns else base
    j = months.join(b.select(*keys, order, "base_discount_pct"), [*keys, order], "left")
    return Q.fill_gaps(j, keys, order, ["base_discount_pct"]).fillna(0.0, ["base_discount_pct"])


def _to_period(days: DataFrame, keys, grain: str) -> DataFrame:
    cols = [c for c in ("orders", "quantity", "total_discount", "sales_value") if c in days.columns]
    g = days.groupBy(*keys, period_of("period", grain).alias("out_period")).agg(
        *[F.sum(c).alias(c) for c in cols],
        *([F.min_by("base_discount_pct", "period").alias("base_discount_pct")] if "base_discount_pct" in days.columns else []))
    return g.withColumnRenamed("out_period", "period").withColumn(
        "actual_discount_pct", ratio("total_discount", "sales_value", 100.0, 0.0))


def base_depth_points(basis: DataFrame, keys=(), p: BaseParams = BaseParams()) -> DataFrame:
    """Actual, base and tactical discount per period and key, for all keys in one plan."""
    keys = list(keys)
    days = daily_discount(basis, keys)
    if p.mode == "define":
        points = month_base(_to_period(days, keys, "M"), keys, p)
    else:
        # Key x day rows are read twice from here on.
        days = cut(days)
        base = block_base(days, keys, p)
        marked = days.withColumn("month", month_of("period")).join(base, [*keys, "month"]).drop("month")
        points = marked if p.grain == "D" else _to_period(marked, keys, p.grain)
    tactical = F.greatest(F.col("actual_discount_pct") - F.col("base_discount_pct"), F.lit(0.0))
    return points.withColumn("tactical_discount_pct", tactical)


def base_depth_summary(points: DataFrame, keys=()) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count("*").alias("periods"), F.avg("actual_discount_pct").alias("avg_actual_discount_pct"),
        F.avg("base_discount_pct").alias("avg_base_discount_pct"),
        F.avg("tactical_discount_pct").alias("avg_tactical_discount_pct"),
        F.max("actual_discount_pct").alias("max_actual_discount_pct"),
        F.max("base_discount_pct").alias("max_base_discount_pct"))


def legacy_slab_base(slab="Slab"):
    """The older fixed base per slab."""
    s = F.lower(F.col(slab))
    return F.when(s == "slab0", 8.0).when(s == "slab1", 11.0).otherwise(14.0)
