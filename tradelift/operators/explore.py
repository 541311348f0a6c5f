"""Exploratory tables over the fact."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tradelift.functions.columns import allowed_slab, fiscal_label, fmt_g, month_of, outlet_group, positive_ratio, ratio, total
from tradelift.operators import sequence as Q, sketches
from tradelift.operators.fit import constrained_ridge

SALES, QTY, DISC = "SalesValue_atBasicRate", "Quantity", "TotalDiscount"


def _sums(**more):
    return [F.sum(SALES).alias("sales_value"), F.sum(QTY).alias("quantity"), *[F.sum(c).alias(n) for n, c in more.items()]]


def size_month_trend(df: DataFrame) -> DataFrame:
    g = df.groupBy(month_of("Date").alias("period"), "Sizes").agg(*_sums(total_discount=DISC))
    return g.withColumn("discount_pct", F.round(positive_ratio("total_discount", "sales_value", 100.0), 2))


def slab_trend(df: DataFrame) -> DataFrame:
    """Month, size and slab: discount, volume, revenue, weighted MRP and month-on-month change."""
    work = df.withColumn("__m", F.coalesce("MRP", F.lit(0.0)) * F.coalesce(QTY, F.lit(0.0)))
    g = work.groupBy(month_of("Date").alias("period"), "Sizes", "Slab").agg(*_sums(discount_value=DISC, mrp_x_qty="__m"))
    g = g.withColumns({
        "discount_pct": positive_ratio("discount_value", "sales_value", 100.0, 0.0),
        "mrp": positive_ratio("mrp_x_qty", "quantity", 1.0, 0.0)})
    return Q.pct_change(g, ["Sizes", "Slab"], "period", {
        "quantity": "volume_change_pct", "sales_value": "revenue_change_pct"}).drop("mrp_x_qty")


def pack_trend(slabs: DataFrame) -> DataFrame:
    """Slab trend rolled up to packs: sales-weighted discount, volume-weighted MRP."""
    paid = F.col("sales_value") > 0
    return slabs.groupBy("period", "Sizes").agg(
        F.sum("sales_value").alias("sales"), F.sum("quantity").alias("volume"),
        F.coalesce(F.sum(F.when(paid, F.col("sales_value") * F.col("discount_pct"))) / F.sum(F.when(paid, F.col("sales_value"))),
                   F.lit(0.0)).alias("discount_pct"),
        F.coalesce(F.sum(F.when(F.col("quantity") > 0, F.col("mrp") * F.col("quantity"))) / F.nullif(F.sum("quantity"), F.lit(0.0)),
                   F.lit(0.0)).alias("mrp"))


def top_n(df: DataFrame, n: int, by, ties=()) -> DataFrame:
    """The first n by the given columns, all falling; each task keeps n rows at most."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in by], *[F.asc(t) for t in ties]).limit(n)


def product_options(df: DataFrame, n: int = 20) -> DataFrame:
    keys = ["Sku_Code", "Sku_Name", "Brand", "Sizes"]
    g = df.dropna(subset=keys).groupBy(*keys).agg(*_sums())
    g = top_n(g, n, ["sales_value", "quantity"], ["Sku_Code"]).where(F.trim("Sku_Code") != "")
    return g.withColumn("label", F.concat(
        F.trim("Sku_Name"), F.lit(" | "), F.trim("Sizes"), F.lit(" | "), F.trim("Brand"), F.lit(" ("), F.trim("Sku_Code"), F.lit(")")))


def brand_share_join(products: DataFrame, base: DataFrame) -> DataFrame:
    """Product rows with their brand's totals. Brands are few, so Spark can broadcast the totals; a
    brand holding most products stays spread."""
    brands = base.groupBy("Brand").agg(F.sum(SALES).alias("brand_sales_value"), F.sum(QTY).alias("brand_quantity"))
    return products.join(brands, "Brand", "left").withColumns({
        "value_contribution_pct": positive_ratio("sales_value", "brand_sales_value", 100.0, 0.0),
        "volume_contribution_pct": positive_ratio("quantity", "brand_quantity", 100.0, 0.0)})


def product_contribution(base: DataFrame, product_codes=(), n: int = 50) -> DataFrame:
    keys = ["Sku_Code", "Sku_Name", "Brand", "Category", "Subcategory", "Sizes"]
    scope = base.where(F.col("Sku_Code").isin(*product_codes)) if product_codes else base
    g = scope.dropna(subset=keys).groupBy(*keys).agg(*_sums())
    if not product_codes:
        g = top_n(g, n, ["sales_value", "quantity"], ["Sku_Code"])
    return brand_share_join(g, base)


def mix_tables(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """dim, label, sums and shares of the first k values of every dimension in {dimension: k}, in one pass: a row gives one
    pair for each dimension, and equal pairs combine before the shuffle. A missing value counts."""
    label = lambda d: F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("Unknown"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), label(d).alias("label")) for d in dims])
    g = df.select(SALES, QTY, F.explode(pairs).alias("p")).groupBy("p.dim", "p.label").agg(*_sums())
    whole = Window.partitionBy("dim")
    g = g.withColumns({
        "value_pct": positive_ratio(F.col("sales_value"), F.sum("sales_value").over(whole), 100.0, 0.0),
        "volume_pct": positive_ratio(F.col("quantity"), F.sum("quantity").over(whole), 100.0, 0.0),
        "__r": F.row_number().over(whole.orderBy(F.desc_nulls_last("sales_value"), "label"))})
    most = F.lit(0)
    for d, k in dims.items():
        most = F.when(F.col("dim") == d, k).otherwise(most)
    return g.where(F.col("__r") <= most).drop("__r")


def mix_rows(df: DataFrame, dim: str, k: int = 12) -> DataFrame:
    """Top k values of a dimension with their share of all sales and volume."""
    return mix_tables(df, {dim: k}).drop("dim")


def selected_vs_other(df: DataFrame, dim: str, selected, within: Column | None = None) -> DataFrame:
    """Two rows: the selected values of a dimension and the rest, in one pass."""
    rows = df if within is None else df.where(within)
    hit = F.coalesce(F.col(dim).isin(*selected), F.lit(False))
    s = rows.agg(
        F.sum(F.when(hit, F.col(SALES))).alias("ss"), F.sum(F.when(hit, F.col(QTY))).alias("sq"),
        F.sum(SALES).alias("us"), F.sum(QTY).alias("uq")).fillna(0.0)
    pair = F.array(
        F.struct(F.lit("selected").alias("key"), F.col("ss").alias("sales_value"), F.col("sq").alias("quantity")),
        F.struct(F.lit("other").alias("key"), F.greatest(F.col("us") - F.col("ss"), F.lit(0.0)).alias("sales_value"),
                 F.greatest(F.col("uq") - F.col("sq"), F.lit(0.0)).alias("quantity")))
    return s.select("us", "uq", F.explode(pair).alias("r")).select(
        "r.key", "r.sales_value", "r.quantity", positive_ratio(F.col("r.sales_value"), F.col("us"), 100.0, 0.0).alias("value_pct"),
        positive_ratio(F.col("r.quantity"), F.col("uq"), 100.0, 0.0).alias("volume_pct"))


def subcat_sections(df: DataFrame, k: int = 12) -> DataFrame:
    """Per category its k largest sub-categories with their share of the category."""
    g = df.dropna(subset=["Category", "Subcategory"]).groupBy("Category", "Subcategory").agg(*_sums())
    cat = g.groupBy("Category").agg(F.sum("sales_value").alias("__s"), F.sum("quantity").alias("__q"))
    t = Q.top_k_per_group(g, ["Category"], "sales_value", k, ["Subcategory"]).join(cat, "Category")
    return t.withColumns({
        "value_pct": positive_ratio("sales_value", "__s", 100.0, 0.0),
        "volume_pct": positive_ratio("quantity", "__q", 100.0, 0.0)}).drop("__s", "__q")


def scope_summary(df: DataFrame, lg_k: int | None = None) -> DataFrame:
    """Rows, distinct outlets, bills, products and brands, span and totals.

    One pass yields (name, value) pairs that combine before they shuffle, a second the plain totals; a
    direct multi-column distinct count would copy every row once per column. With `lg_k` the distinct counts
    are estimates by sketches (`sketches`), in one pass."""
    named = {"total_outlets": "Outlet_ID", "total_bills": "Bill_No", "distinct_products": "Sku_Code", "distinct_brands": "Brand"}
    totals = [F.count("*").alias("total_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
              F.sum(SALES).alias("total_sales_value"), F.sum(QTY).alias("total_quantity")]
    if lg_k is not None:
        return df.agg(*totals, *[sketches.estimate(c, lg_k).alias(n) for n, c in named.items()]).withColumn("days", F.datediff("last_date", "first_date"))
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("v")) for n, c in named.items()])
    seen = df.select(F.explode(pairs).alias("p")).select("p.n", "p.v").where("v IS NOT NULL").distinct().groupBy("n").agg(F.count("*").alias("k"))
    counts = seen.agg(F.struct(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col("k"))), F.lit(0)).alias(n) for n in named])).scalar()
    return df.agg(*totals).select("*", *[counts[n].alias(n) for n in named], F.datediff("last_date", "first_date").alias("days"))


def slab_mix(outlet_months: DataFrame) -> DataFrame:
    """Outlet-months, outlets and quantity per size and slab from (Outlet_ID, Sizes, Slab, Month,
    Monthly_Quantity) rows."""
    per = outlet_months.where("Slab IS NOT NULL AND Slab <> 'slab0'").select(
        "Sizes", "Outlet_ID", "Month", "Slab", "Monthly_Quantity").distinct().groupBy("Sizes", "Slab", "Outlet_ID").agg(
        F.count("*").alias("m"), F.sum("Monthly_Quantity").alias("q"))
    g = per.groupBy("Sizes", "Slab").agg(F.sum("m").alias("outlet_months"), F.count("*").alias("unique_outlets"), F.sum("q").alias("quantity"))
    return g.withColumn("quantity_pct", F.round(
        positive_ratio("quantity", F.sum("quantity").over(Window.partitionBy("Sizes")), 100.0), 2))


def outlet_discount_variation(df: DataFrame) -> DataFrame:
    """Every outlet of every size-slab-month cell: its discount, and how far it is from the cell's. Invoices are added up
    where the rows have their number, as those of scope.outlet_months do.

    Cell rates are aggregated and joined back, so a cell with very many outlets is never one task."""
    keys = ["Sizes", "Slab", "Month"]
    by = df.groupBy(*keys, "Outlet_ID").agg(
        F.sum(SALES).alias("sales_value"), F.sum(DISC).alias("total_discount"), F.sum(QTY).alias("quantity"),
        F.sum("rows").alias("rows") if "rows" in df.columns else F.count(QTY).alias("rows"),
        *([F.sum("invoices").alias("invoices")] if "invoices" in df.columns else []))
    cell = by.groupBy(*keys).agg(F.sum("sales_value").alias("__s"), F.sum("total_discount").alias("__d"))
    cell = cell.select(*keys, ratio("__d", "__s", 100.0).alias("cell_discount_pct"))
    out = by.where("sales_value > 0").join(cell, keys)
    out = out.withColumn("outlet_discount_pct", F.round(F.col("total_discount") / F.col("sales_value") * 100.0, 2))
    out = out.withColumn("deviation_pp", F.round(F.col("outlet_discount_pct") - F.col("cell_discount_pct"), 2))
    return out.withColumn("abs_deviation_pp", F.abs("deviation_pp"))


def variation_cells(variation: DataFrame) -> DataFrame:
    """Outlets, rows, invoices where known (each outlet's own), and the mean absolute deviation of every size-slab-month cell."""
    known = [c for c in ("rows", "invoices") if c in variation.columns]
    return variation.groupBy("Sizes", "Slab", "Month").agg(
        F.count("*").alias("outlets"), *[F.sum(c).alias(c) for c in known], F.avg("abs_deviation_pp").alias("mean_abs_deviation_pp"))


def ranked_variation(variation: DataFrame, n: int = 100) -> DataFrame:
    """The first n outlets of every cell by absolute deviation, then sales, with their rank; each task keeps n a cell."""
    order = Window.partitionBy("Sizes", "Slab", "Month").orderBy(F.desc("abs_deviation_pp"), F.desc("sales_value"), "Outlet_ID")
    return variation.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def discount_histogram(variation: DataFrame, keys=("Sizes", "Slab"), band: float = 0.5) -> DataFrame:
    """Outlets per discount band and their share within the keys."""
    low = F.floor(F.col("outlet_discount_pct") / band) * band
    g = variation.groupBy(*keys, low.cast("double").alias("band_from")).agg(F.count("*").alias("outlets"))
    return g.withColumn("outlet_pct", F.round(F.col("outlets") / F.sum("outlets").over(Window.partitionBy(*keys)) * 100.0, 2))


def scheme_amounts(df: DataFrame) -> DataFrame:
    """Rows with scheme and top-up times quantity, which may be summed by outlet and day first."""
    q = F.col(QTY)
    return df.withColumns({"scheme_qty": F.coalesce("Scheme_Discount", F.lit(0.0)) * q, "qps_qty": F.coalesce("Staggered_qps", F.lit(0.0)) * q})


def scheme_calendar(df: DataFrame) -> DataFrame:
    """Month, size and slab: volume and quantity-weighted base, top-up and total scheme."""
    d = df if "scheme_qty" in df.columns else scheme_amounts(df)
    return d.groupBy(month_of("Date").alias("period"), "Sizes", "Slab").agg(
        F.sum(QTY).alias("volume"), F.sum("scheme_qty").alias("__b"), F.sum("qps_qty").alias("__t")).select(
        "period", "Sizes", "Slab", "volume", positive_ratio("__b", "volume").alias("base_scheme"),
        positive_ratio("__t", "volume").alias("qps_topup"), positive_ratio(F.col("__b") + F.col("__t"), "volume").alias("total_scheme"))


def pack_month_revenue(basis: DataFrame) -> DataFrame:
    return basis.groupBy(month_of("Date").alias("period"), "Sizes").agg(
        F.sum(QTY).alias("volume"), F.sum("dsp_sales").alias("gross_revenue"), F.sum("clp_sales").alias("net_revenue"))


def _in_spans(date: str, spans) -> Column:
    """Whether a date lies in one of the spans (first day, day after the last); touching spans are one."""
    whole = []
    for a, b in sorted(spans):
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    ok = F.lit(False)
    for a, b in whole:
        ok = ok | ((F.col(date) >= F.lit(a)) & (F.col(date) < F.lit(b)))
    return ok


def yoy_table(df: DataFrame, first: int, second: int, months=tuple(range(1, 13))) -> DataFrame:
    """Calendar month by two years with the change, per size. The months are also stated as ranges of Date, which reach the scan."""
    spans = [(dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1)) for y in (first, second) for m in months]
    w = df.where(_in_spans("Date", spans))
    g = w.groupBy("Sizes", F.month("Date").alias("month_no")).agg(*[
        F.sum(F.when(F.year("Date") == y, F.col(c))).alias(f"{n}_{y}")
        for n, c in (("sales", SALES), ("volume", QTY)) for y in (first, second)])
    return g.withColumns({
        f"{n}_yoy_pct": F.round(ratio(F.col(f"{n}_{second}") - F.col(f"{n}_{first}"), F.col(f"{n}_{first}"), 100.0), 2)
        for n in ("sales", "volume")})


def size_contribution(df: DataFrame, sizes=()) -> DataFrame:
    """Packs' share of the whole scope; `sizes` limits the rows shown, not the denominator."""
    g = df.groupBy("Sizes").agg(*_sums())
    g = g.withColumns({"total_sales": total("sales_value"), "total_quantity": total("quantity")})
    g = g.withColumns({
        "value_contribution_pct": F.round(ratio("sales_value", "total_sales", 100.0), 2),
        "volume_contribution_pct": F.round(ratio("quantity", "total_quantity", 100.0), 2)})
    return g.where(F.col("Sizes").isin(*sizes)) if sizes else g


def class_mix(df: DataFrame) -> DataFrame:
    """Per pack: each outlet class, then wholesale against the rest, with their shares."""
    pack = Window.partitionBy("Sizes")

    def shares(g, kind):
        return g.select("Sizes", F.lit(kind).alias("kind"), "label", "sales_value", "quantity",
                        F.round(ratio(F.col("sales_value"), F.sum("sales_value").over(pack), 100.0, 0.0), 2).alias("value_pct"),
                        F.round(ratio(F.col("quantity"), F.sum("quantity").over(pack), 100.0, 0.0), 2).alias("volume_pct"))

    detail = df.groupBy("Sizes", F.upper(F.trim("Final_Outlet_Classification")).alias("label")).agg(*_sums())
    two = detail.groupBy("Sizes", F.when(F.col("label") == "WH", "WH").otherwise("Others").alias("label")).agg(
        F.sum("sales_value").alias("sales_value"), F.sum("quantity").alias("quantity"))
    return shares(detail, "class").unionByName(shares(two, "wh_vs_others"))


def class_label(c="Final_Outlet_Classification") -> Column:
    v = F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return F.when(v.isin("", "NAN", "NONE"), "UNKNOWN").otherwise(v)


def unique_outlets(df: DataFrame) -> DataFrame:
    """Distinct outlets per class and their share of all distinct outlets."""
    pairs = df.select(F.trim("Outlet_ID").alias("o"), class_label().alias("outlet_class")).distinct()
    everyone = pairs.select("o").distinct().agg(F.count("o")).scalar()
    return pairs.groupBy("outlet_class").agg(F.count("o").alias("unique_outlets")).withColumn(
        "outlet_pct", F.round(ratio(F.col("unique_outlets"), everyone, 100.0), 2))


def promo_rate(df: DataFrame) -> DataFrame:
    """Discount rate by class, and by size and class, from one grouping-sets aggregation."""
    d = df.withColumn("outlet_class", class_label())
    g = d.groupingSets([["outlet_class"], ["Sizes", "outlet_class"]], "Sizes", "outlet_class").agg(*_sums(total_discount=DISC))
    return g.fillna("ALL", ["Sizes"]).withColumn("avg_discount_pct", F.round(ratio("total_discount", "sales_value", 100.0), 2))


def subcat_month_metrics(df: DataFrame) -> DataFrame:
    g = df.groupBy(month_of("Date").alias("period"), "Subcategory").agg(*_sums(), F.count("*").alias("rows"))
    return g


def subcat_month(df: DataFrame) -> DataFrame:
    """Distinct sub-categories per month: count and sorted list (bounded by the catalogue)."""
    d = df.select(month_of("Date").alias("period"), F.trim("Subcategory").alias("s")).where("s <> ''").distinct()
    return d.groupBy("period").agg(F.count("*").alias("subcategory_count"), F.array_join(F.sort_array(F.collect_set("s")), ", ").alias("subcategories"))


def presence_rows(df: DataFrame) -> DataFrame:
    """(period, subcategory) for every sub-category that sold in the month; presence_matrix() makes columns of chosen ones."""
    d = df.select(month_of("Date").alias("period"), F.trim("Subcategory").alias("subcategory"))
    return d.where("subcategory <> ''").distinct()


def presence_matrix(df: DataFrame, subcategories) -> DataFrame:
    """1 where a sub-category sold in the month."""
    return df.groupBy(month_of("Date").alias("period")).pivot("Subcategory", list(subcategories)).agg(
        F.count(F.lit(1))).select("period", *[
            F.when(F.col(f"`{s}`") > 0, 1).otherwise(0).alias(s) for s in subcategories])


def fy_region(df: DataFrame, regions: dict[str, str], labels=(), until=None) -> DataFrame:
    """Fiscal year and size: sales and quantity per named region and in total. `until` cuts the last,
    partial year."""
    d = df.withColumn("fy", fiscal_label("Date"))
    if labels:
        # a label leaves the century open; the ranges of Date reach the scan
        years = [c + int(x[-2:]) for x in labels for c in (1900, 2000)]
        d = d.where(_in_spans("Date", [(dt.date(y - 1, 4, 1), dt.date(y, 4, 1)) for y in years]) & F.col("fy").isin(*labels))
    if until is not None:
        d = d.where(F.col("Date") <= F.lit(until).cast("date"))

    def part(c, name):
        return [F.coalesce(F.sum(F.when(F.col("Final_State") == s, F.col(c))), F.lit(0.0)).alias(f"{name}_{n}") for s, n in regions.items()]

    return d.groupBy("fy", "Sizes").agg(*part(SALES, "sales"), F.sum(SALES).alias("total_sales"), *part(QTY, "quantity"), F.sum(QTY).alias("total_quantity"))


def wh_contribution(df: DataFrame, slabs=()) -> DataFrame:
    """Wholesale share of sales per size and slab, as a conditional sum. All slabs from slab1 on unless `slabs` names some."""
    d = df.withColumn("Slab", F.lower(F.trim("Slab")))
    d = d.where(F.col("Slab").isin(*slabs)) if slabs else d.where(allowed_slab("Slab"))
    g = d.groupBy("Sizes", "Slab").agg(
        F.sum(SALES).alias("total_sales"),
        F.coalesce(F.sum(F.when(outlet_group("Final_Outlet_Classification") == "WH", F.col(SALES))), F.lit(0.0)).alias("wh_sales"))
    return g.withColumn("wh_contribution_pct", F.round(ratio("wh_sales", "total_sales", 100.0), 2))


def wh_share(df: DataFrame, keys=("Final_State", "Sizes", "Slab")) -> DataFrame:
    """Sales of all and of wholesale outlets per key and the wholesale share. The wholesale side is a condition inside the one
    aggregation, so nothing is joined."""
    wh = F.when(outlet_group("Final_Outlet_Classification") == "WH", F.col(SALES))
    g = df.groupBy(*keys).agg(F.sum(SALES).alias("total_sales"), F.coalesce(F.sum(wh), F.lit(0.0)).alias("wh_sales"))
    return g.withColumn("wh_share_pct", F.round(ratio("wh_sales", "total_sales", 100.0), 2))


def discount_corr(df: DataFrame, keys, target: str, features) -> DataFrame:
    """Correlation of each feature with the target per group; nothing for flat or single rows. Spark's own `corr` divides by the
    deviations of a flat group before any condition on its result, which is an error under ANSI rules."""
    t = F.col(target).cast("double")
    aggs = []
    for f in features:
        x = F.when(t.isNotNull(), F.col(f).cast("double"))
        y = F.when(F.col(f).isNotNull(), t)
        live = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
        aggs.append(F.when(live, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"corr_{f}"))
    return df.groupBy(*keys).agg(*aggs)


def slab_rules(breaks: DataFrame) -> DataFrame:
    """(Sizes, breaks array) to one rule text per slab, the lowest left out."""
    b = breaks.select("Sizes", F.array_sort(F.array_distinct("breaks")).alias("b"))
    i = b.select("Sizes", "b", F.explode(F.sequence(F.lit(1), F.size("b"))).alias("i"))
    lo, hi = F.element_at("b", F.col("i")), F.try_element_at("b", F.col("i") + 1)
    return i.select("Sizes", F.concat(F.lit("slab"), F.col("i")).alias("Slab"), F.when(
        hi.isNull(), F.concat(F.lit("Qty >= "), fmt_g(lo))).otherwise(
        F.concat(fmt_g(lo), F.lit(" <= Qty < "), fmt_g(hi))).alias("rule"))


def mrp_dates(df: DataFrame, size: str, mrp: float) -> DataFrame:
    """Distinct sale dates of one pack at one price with the first and last of them."""
    days = df.where((F.col("Sizes") == size) & (F.col("MRP") == mrp)).select("Date").distinct()
    span = days.agg(F.struct(F.min("Date").alias("a"), F.max("Date").alias("b"), F.count("*").alias("n")).alias("s")).scalar()
    return days.select("Date", span["a"].alias("first_date"), span["b"].alias("last_date"), span["n"].alias("unique_dates"))


def price_change_months(df: DataFrame, product="Sku_Code") -> DataFrame:
    """Months per size in which some product's median MRP differs from its month before."""
    prices = df.where(F.col("MRP").isNotNull() & (F.trim(product) != "")).groupBy(
        "Sizes", F.trim(product).alias("product"), month_of("Date").alias("period"), "MRP").agg(F.count("*").alias("n"))
    m = prices.groupBy("Sizes", "product", "period").agg(F.percentile("MRP", F.lit(0.5), F.col("n")).alias("mrp"))
    prev = F.lag("mrp").over(Window.partitionBy("Sizes", "product").orderBy("period"))
    return m.withColumn("__p", prev).where(F.abs(F.col("mrp") - F.col("__p")) > 1e-9).groupBy("Sizes", "period").agg(
        F.count("*").alias("products_changed"))


def dominant_price(df: DataFrame) -> DataFrame:
    """MRP with the largest quantity per pack and month (ties: the lower) and its shift."""
    q = df.where("MRP IS NOT NULL").groupBy("Sizes", month_of("Date").alias("period"), "MRP").agg(
        F.sum(F.coalesce(QTY, F.lit(0.0))).alias("q"))
    d = q.groupBy("Sizes", "period").agg(F.max_by("MRP", F.struct("q", -F.col("MRP"))).alias("dominant_mrp"), F.max("q").alias("total_qty"))
    prev = F.lag("dominant_mrp").over(Window.partitionBy("Sizes").orderBy("period"))
    return d.withColumn("prev_mrp", prev).withColumn("mrp_change", F.col("dominant_mrp") - F.col("prev_mrp"))


def log_trend_rows(months: DataFrame, keys, value: str, order="period") -> DataFrame:
    d = months.withColumns({
        "t": (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("double"),
        "y_log": F.ln(F.greatest(F.col(value), F.lit(1e-9)))})
    return d.withColumns({f"d{m}": (F.month(order) == m).cast("double") for m in range(2, 13)})


def trend_seasonality(months: DataFrame, keys, value: str, order="period"):
    """(summary, seasonal index rows, fitted rows) of log(value) on time and calendar months. The fit
    runs on one row of moments per series."""
    keys = list(keys)
    d = log_trend_rows(months, keys, value, order)
    xs = {"t": 0} | {f"d{m}": 0 for m in range(2, 13)}
    fit = constrained_ridge(d, keys, "y_log", xs, 0.0)
    span = d.groupBy(*keys).agg(F.count("*").alias("n_months"), F.min(order).alias("start_month"), F.max(order).alias("end_month"))
    b = F.col("coef_t")
    summary = fit.join(span, keys).join(theil_sen(d, keys), keys).select(
        *keys, "n_months", "start_month", "end_month", ((F.exp(b) - 1) * 100).alias("monthly_growth_pct"),
        ((F.exp(b * 12) - 1) * 100).alias("annualized_growth_pct"), F.col("r2").alias("r2_log_model"),
        F.when(F.col("n_months") >= 3, (F.exp("theil_sen_slope") - 1) * 100).alias("theilsen_monthly_growth_pct"))
    effects = F.array(F.struct(F.lit(1).alias("month_no"), F.lit(0.0).alias("effect")), *[
        F.struct(F.lit(m).alias("month_no"), F.col(f"coef_d{m}").alias("effect")) for m in range(2, 13)])
    seen = d.select(*keys, F.month(order).alias("month_no")).distinct()
    raw = fit.select(*keys, F.explode(effects).alias("e")).select(*keys, "e.month_no", F.exp("e.effect").alias("raw")).join(seen, [*keys, "month_no"])
    index = raw.select(*keys, "month_no", (F.col("raw") / F.avg("raw").over(Window.partitionBy(*keys))).alias("seasonality_index"))
    yhat = F.col("intercept")
    for x in xs:
        yhat = yhat + F.col(f"coef_{x}") * F.col(x)
    fitted = d.join(fit, keys).select(*keys, order, F.col(value).alias("actual"), F.exp(yhat).alias("fitted"))
    return summary, index, fitted


def theil_sen(rows: DataFrame, keys, x="t", y="y_log") -> DataFrame:
    """Median slope between any two months of a series. A series has one row per calendar month, so a
    group is a few hundred rows at most."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("theil_sen_slope", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        i, j = np.triu_indices(len(a), 1)
        slope = float(np.median((b[j] - b[i]) / (a[j] - a[i]))) if len(i) else np.nan
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "theil_sen_slope": [slope]})

    return rows.select(*keys, x, y).groupBy(*keys).applyInPandas(run, schema)
