"""Exploration queries."""

from pyspark.sql import functions as F

from tradelift.functions import columns as K
from tradelift.operators import discount as D, explore as P, frame as M, scope as S, sketches
from tradelift.plans.discount import BASIS, defined_days, month_frame, r
from tradelift.plans.fixtures import txn
from tradelift.plans.registry import query, view
from tradelift.plans.scope import RULES

SV, TD, Q_ = '"SalesValue_atBasicRate"', '"TotalDiscount"', '"Quantity"'
CORE = ("Date", "Sizes", "Quantity", "SalesValue_atBasicRate", "TotalDiscount")
SUMS = f"round(sum({SV}), 4) AS sales_value, round(sum({Q_}), 4) AS quantity"


@query("size_month_trend", f"""SELECT "Month" AS period, "Sizes", {SUMS}, round(sum({TD}), 4) AS total_discount, round(sum({TD}) / sum({SV}) * 100, 2) AS discount_pct FROM txn GROUP BY ALL""")
def _(spark, sf):
    return r(P.size_month_trend(txn(spark, sf, *CORE)))


view("v_trend", f"""
SELECT *, disc / sv * 100 AS pct, coalesce((q / lag(q) OVER w - 1) * 100, 0) AS dq, coalesce((sv / lag(sv) OVER w - 1) * 100, 0) AS dv, mq2 / q AS mrp FROM (
  SELECT "Month" AS period, "Sizes", "Slab", sum({Q_}) AS q, sum({SV}) AS sv, sum({TD}) AS disc, sum("MRP" * {Q_}) AS mq2 FROM txn WHERE "Slab" <> 'slab0' GROUP BY ALL)
WINDOW w AS (PARTITION BY "Sizes", "Slab" ORDER BY period)
""")


def trend(spark, sf):
    return P.slab_trend(txn(spark, sf, *CORE, "MRP", "Slab").where(K.allowed_slab("Slab")))


@query("slab_trend", """SELECT period, "Sizes", "Slab", round(sv, 4) AS sales_value, round(q, 4) AS quantity, round(disc, 4) AS discount_value, round(pct, 6) AS discount_pct, CAST(round(CAST(mrp AS DECIMAL(38,8)), 4) AS DOUBLE) AS mrp,
  round(dq, 6) AS volume_change_pct, round(dv, 6) AS revenue_change_pct FROM v_trend""")
def _(spark, sf):
    t = trend(spark, sf)
    return r(t.withColumn("mrp", K.half_up("mrp", 4)), discount_pct=6, volume_change_pct=6, revenue_change_pct=6)


@query("pack_trend", """SELECT period, "Sizes", round(sum(sv), 4) AS sales, round(sum(q), 4) AS volume, round(sum(sv * pct) / sum(sv), 6) AS discount_pct, round(sum(mrp * q) / sum(q), 5) AS mrp FROM v_trend GROUP BY ALL""")
def _(spark, sf):
    return r(P.pack_trend(trend(spark, sf)), discount_pct=6, mrp=5)


@query("product_options", f"""
SELECT "Sku_Code", "Sku_Name", "Brand", "Sizes", {SUMS}, "Sku_Name" || ' | ' || "Sizes" || ' | ' || "Brand" || ' (' || "Sku_Code" || ')' AS label
FROM txn GROUP BY ALL ORDER BY sum({SV}) DESC, sum({Q_}) DESC, "Sku_Code" LIMIT 25
""")
def _(spark, sf):
    return r(P.product_options(txn(spark, sf, *CORE, "Sku_Code", "Sku_Name", "Brand"), 25))


_PROD = f"""
SELECT p.*, round(bs, 4) AS brand_sales_value, round(bq, 4) AS brand_quantity, round(sales_value / bs * 100, 6) AS value_contribution_pct, round(quantity / bq * 100, 6) AS volume_contribution_pct FROM (
  SELECT "Sku_Code", "Sku_Name", "Brand", "Category", "Subcategory", "Sizes", {SUMS} FROM txn {{w}} GROUP BY ALL {{o}}) p
JOIN (SELECT "Brand", sum({SV}) AS bs, sum({Q_}) AS bq FROM txn GROUP BY 1) USING ("Brand")
"""
PRODUCT = ("Sku_Code", "Sku_Name", "Brand", "Category", "Subcategory")


@query("product_contribution", _PROD.format(w="", o=f'ORDER BY sum({SV}) DESC, sum({Q_}) DESC, "Sku_Code" LIMIT 50'))
def _(spark, sf):
    return r(P.product_contribution(txn(spark, sf, *CORE, *PRODUCT)), value_contribution_pct=6, volume_contribution_pct=6)


@query("brand_share_join", _PROD.format(w="", o=""))
def _(spark, sf):
    t = txn(spark, sf, *CORE, *PRODUCT)
    g = t.groupBy(*PRODUCT, "Sizes").agg(F.sum(P.SALES).alias("sales_value"), F.sum(P.QTY).alias("quantity"))
    return r(P.brand_share_join(g, t), value_contribution_pct=6, volume_contribution_pct=6)


@query("top_n", f"""SELECT "Outlet_ID", round(sum({SV}), 4) AS sales FROM txn GROUP BY 1 ORDER BY sum({SV}) DESC, 1 LIMIT 15""")
def _(spark, sf):
    g = txn(spark, sf, "Outlet_ID", P.SALES).groupBy("Outlet_ID").agg(F.sum(P.SALES).alias("sales"))
    return r(P.top_n(g, 15, ["sales"], ["Outlet_ID"]))


@query("mix_rows", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{d}' AS dim, "{d}" AS label, {SUMS}, round(sum({SV}) / (SELECT sum({SV}) FROM txn) * 100, 6) AS value_pct, round(sum({Q_}) / (SELECT sum({Q_}) FROM txn) * 100, 6) AS volume_pct
FROM txn GROUP BY "{d}" ORDER BY sum({SV}) DESC LIMIT {k})""" for d, k in (("Final_State", 10), ("Brand", 12), ("Category", 12))))
def _(spark, sf):
    t = txn(spark, sf, "Final_State", "Brand", "Category", P.SALES, P.QTY)
    return r(P.mix_tables(t, {"Final_State": 10, "Brand": 12, "Category": 12}), value_pct=6, volume_pct=6)


@query("selected_vs_other", f"""
SELECT key, round(s, 4) AS sales_value, round(q, 4) AS quantity, round(s / us * 100, 6) AS value_pct, round(q / uq * 100, 6) AS volume_pct FROM (
  SELECT 'selected' AS key, sum({SV}) FILTER ("Category" IN ('PROMO', 'SMALL')) AS s, sum({Q_}) FILTER ("Category" IN ('PROMO', 'SMALL')) AS q, sum({SV}) AS us, sum({Q_}) AS uq FROM txn
  UNION ALL SELECT 'other', sum({SV}) FILTER ("Category" NOT IN ('PROMO', 'SMALL')), sum({Q_}) FILTER ("Category" NOT IN ('PROMO', 'SMALL')), sum({SV}), sum({Q_}) FROM txn)
""")
def _(spark, sf):
    return r(P.selected_vs_other(txn(spark, sf, "Category", P.SALES, P.QTY), "Category", ["PROMO", "SMALL"]), value_pct=6, volume_pct=6)


@query("subcat_sections", f"""
SELECT "Category", "Subcategory", round(s, 4) AS sales_value, round(q, 4) AS quantity, CAST(rn AS INTEGER) AS rank, round(s / cs * 100, 6) AS value_pct, round(q / cq * 100, 6) AS volume_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY "Category" ORDER BY s DESC, "Subcategory") AS rn, sum(s) OVER (PARTITION BY "Category") AS cs, sum(q) OVER (PARTITION BY "Category") AS cq
  FROM (SELECT "Category", "Subcategory", sum({SV}) AS s, sum({Q_}) AS q FROM txn GROUP BY ALL)) WHERE rn <= 12
""")
def _(spark, sf):
    return r(P.subcat_sections(txn(spark, sf, "Category", "Subcategory", P.SALES, P.QTY)), value_pct=6, volume_pct=6)


@query("scope_summary", f"""
SELECT count(*) AS total_rows, min("Date") AS first_date, max("Date") AS last_date, round(sum({SV}), 2) AS total_sales_value, round(sum({Q_}), 2) AS total_quantity, count(DISTINCT "Outlet_ID") AS total_outlets,
  count(DISTINCT "Bill_No") AS total_bills, count(DISTINCT "Sku_Code") AS distinct_products, count(DISTINCT "Brand") AS distinct_brands, CAST(date_diff('day', min("Date"), max("Date")) AS INTEGER) AS days FROM txn
""")
def _(spark, sf):
    return r(P.scope_summary(txn(spark, sf, "Date", "Outlet_ID", "Bill_No", "Sku_Code", "Brand", P.SALES, P.QTY)), 2)


@query("approx_scope_summary", """
SELECT count(*) AS total_rows, count(DISTINCT "Outlet_ID") AS total_outlets, count(DISTINCT "Bill_No") AS total_bills, count(DISTINCT "Sku_Code") AS distinct_products,
  TRUE AS outlets_within, TRUE AS bills_within, TRUE AS products_within FROM txn
""")
def _(spark, sf):
    t = txn(spark, sf, "Date", "Outlet_ID", "Bill_No", "Sku_Code", "Brand", P.SALES, P.QTY)
    named = {"total_outlets": "outlets_within", "total_bills": "bills_within", "distinct_products": "products_within"}
    near = P.scope_summary(t, sketches.LG_K).select("total_rows", *[F.col(c).alias(f"near_{c}") for c in named])
    both = P.scope_summary(t).select("total_rows", *named).join(near, "total_rows")
    return both.select("total_rows", *named, *[sketches.within(f"near_{c}", c).alias(w) for c, w in named.items()])


@query("slab_mix", """
SELECT "Sizes", "Slab", count(*) AS outlet_months, count(DISTINCT "Outlet_ID") AS unique_outlets, round(sum(mq), 4) AS quantity, round(sum(mq) / sum(sum(mq)) OVER (PARTITION BY "Sizes") * 100, 2) AS quantity_pct
FROM (SELECT DISTINCT "Sizes", "Outlet_ID", "Month", "Slab", mq FROM v_defined WHERE "Slab" <> 'slab0') GROUP BY 1, 2
""")
def _(spark, sf):
    g = S.grain_totals(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity"))
    return r(P.slab_mix(g.withColumn("Slab", S.slab_of("Sizes", "Monthly_Quantity", RULES))))


def variation(spark, sf):
    t = S.outlet_months(txn(spark, sf, *CORE, "Outlet_ID", "Bill_No"), RULES)
    return P.outlet_discount_variation(t.where(K.allowed_slab("Slab")))


view("v_var", f"""
SELECT v.*, round(td / s * 100, 2) AS pct, cd / cs * 100 AS cell FROM (
  SELECT "Sizes", "Slab", "Month", "Outlet_ID", sum({SV}) AS s, sum({TD}) AS td, sum({Q_}) AS q, count(*) AS n, count(DISTINCT "Bill_No") AS invoices FROM v_defined WHERE "Slab" <> 'slab0' GROUP BY ALL) v
JOIN (SELECT "Sizes", "Slab", "Month", sum({SV}) AS cs, sum({TD}) AS cd FROM v_defined WHERE "Slab" <> 'slab0' GROUP BY ALL) USING ("Sizes", "Slab", "Month")
""")


@query("outlet_discount_variation", """
SELECT "Sizes", "Slab", "Month", "Outlet_ID", round(s, 4) AS sales_value, round(td, 4) AS total_discount, round(q, 4) AS quantity, n AS rows, invoices, round(cell, 6) AS cell_discount_pct, pct AS outlet_discount_pct,
  round(pct - cell, 2) AS deviation_pp, abs(round(pct - cell, 2)) AS abs_deviation_pp FROM v_var
""")
def _(spark, sf):
    return r(variation(spark, sf), cell_discount_pct=6)


@query("variation_cells", """
SELECT "Sizes", "Slab", "Month", count(*) AS outlets, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(invoices) AS BIGINT) AS invoices, round(sum(abs(round(pct - cell, 2))), 2) AS abs_deviation_pp FROM v_var WHERE s > 0 GROUP BY ALL
""")
def _(spark, sf):
    v = P.variation_cells(variation(spark, sf))
    # the sum, since a mean of figures with two decimals is often a tie when rounded
    return v.select("Sizes", "Slab", "Month", "outlets", "rows", "invoices", F.round(F.col("mean_abs_deviation_pp") * F.col("outlets"), 2).alias("abs_deviation_pp"))


@query("ranked_variation", """
SELECT * FROM (SELECT "Sizes", "Slab", "Month", "Outlet_ID", abs(round(pct - cell, 2)) AS abs_deviation_pp,
  CAST(row_number() OVER (PARTITION BY "Sizes", "Slab", "Month" ORDER BY abs(round(pct - cell, 2)) DESC, s DESC, "Outlet_ID") AS INTEGER) AS rank FROM v_var WHERE s > 0) WHERE rank <= 10
""")
def _(spark, sf):
    return P.ranked_variation(variation(spark, sf), 10).select("Sizes", "Slab", "Month", "Outlet_ID", "abs_deviation_pp", "rank")


@query("discount_histogram", """
SELECT "Sizes", "Slab", "Month", floor(pct / 0.5) * 0.5 AS band_from, count(*) AS outlets, round(count(*) / sum(count(*)) OVER (PARTITION BY "Sizes", "Slab", "Month") * 100, 2) AS outlet_pct
FROM v_var GROUP BY 1, 2, 3, 4
""")
def _(spark, sf):
    return P.discount_histogram(variation(spark, sf), ["Sizes", "Slab", "Month"])


_half5 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(38,10)), 5) AS DOUBLE)"


@query("scheme_calendar", f"""
SELECT "Month" AS period, "Sizes", "Slab", round(sum({Q_}), 4) AS volume, {_half5(f'sum("Scheme_Discount" * {Q_}) / sum({Q_})')} AS base_scheme, {_half5(f'sum("Staggered_qps" * {Q_}) / sum({Q_})')} AS qps_topup,
  {_half5(f'(sum("Scheme_Discount" * {Q_}) + sum("Staggered_qps" * {Q_})) / sum({Q_})')} AS total_scheme FROM v_defined GROUP BY ALL
""")
def _(spark, sf):
    t = P.scheme_amounts(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity", "Scheme_Discount", "Staggered_qps"))
    out = P.scheme_calendar(S.outlet_days(t, RULES))
    return out.withColumns({"volume": F.round("volume", 4)} | {c: K.half_up(c, 5, 10) for c in ("base_scheme", "qps_topup", "total_scheme")})


@query("pack_month_revenue", """SELECT "Month" AS period, "Sizes", round(sum("Quantity"), 4) AS volume, round(sum(dsp_amt), 4) AS gross_revenue, round(sum(clp_amt), 4) AS net_revenue FROM v_tb GROUP BY ALL""")
def _(spark, sf):
    return r(P.pack_month_revenue(D.discount_basis(txn(spark, sf, *BASIS))))


_Y = {f"{n}_{y}": f"sum({c}) FILTER (year(\"Date\") = {y})" for n, c in (("sales", SV), ("volume", Q_)) for y in (1998, 1999)}


@query("yoy_table", f"""
SELECT "Sizes", CAST(month("Date") AS INTEGER) AS month_no, {', '.join(f'round({e}, 4) AS {n}' for n, e in _Y.items())},
  round(({_Y['sales_1999']} - {_Y['sales_1998']}) / {_Y['sales_1998']} * 100, 2) AS sales_yoy_pct, round(({_Y['volume_1999']} - {_Y['volume_1998']}) / {_Y['volume_1998']} * 100, 2) AS volume_yoy_pct
FROM txn WHERE year("Date") IN (1998, 1999) AND month("Date") BETWEEN 4 AND 11 GROUP BY 1, 2
""")
def _(spark, sf):
    return r(P.yoy_table(txn(spark, sf, *CORE), 1998, 1999, range(4, 12)))


@query("size_contribution", f"""
SELECT "Sizes", {SUMS}, round(sum(sum({SV})) OVER (), 4) AS total_sales, round(sum(sum({Q_})) OVER (), 4) AS total_quantity, round(sum({SV}) / sum(sum({SV})) OVER () * 100, 2) AS value_contribution_pct,
  round(sum({Q_}) / sum(sum({Q_})) OVER () * 100, 2) AS volume_contribution_pct FROM txn GROUP BY "Sizes"
""")
def _(spark, sf):
    return r(P.size_contribution(txn(spark, sf, *CORE)))


_CLS = """SELECT '{k}' AS kind, "Sizes", {e} AS label, {s}, round(sum("SalesValue_atBasicRate") / sum(sum("SalesValue_atBasicRate")) OVER (PARTITION BY "Sizes") * 100, 2) AS value_pct,
  round(sum("Quantity") / sum(sum("Quantity")) OVER (PARTITION BY "Sizes") * 100, 2) AS volume_pct FROM txn WHERE "Outlet_Type" = 'GT' GROUP BY 2, 3"""


@query("class_mix", _CLS.format(k="class", e='"Final_Outlet_Classification"', s=SUMS) + " UNION ALL " + _CLS.format(
    k="wh_vs_others", e="CASE \"Final_Outlet_Classification\" WHEN 'WH' THEN 'WH' ELSE 'Others' END", s=SUMS))
def _(spark, sf):
    return r(P.class_mix(txn(spark, sf, *CORE, "Outlet_Type", "Final_Outlet_Classification").where("Outlet_Type = 'GT'")))


@query("unique_outlets", """SELECT "Final_Outlet_Classification" AS outlet_class, count(DISTINCT "Outlet_ID") AS unique_outlets, round(count(DISTINCT "Outlet_ID") * 100.0 / (SELECT count(DISTINCT "Outlet_ID") FROM txn), 2) AS outlet_pct FROM txn GROUP BY 1""")
def _(spark, sf):
    return P.unique_outlets(txn(spark, sf, "Outlet_ID", "Final_Outlet_Classification"))


@query("promo_rate", f"""
SELECT coalesce("Sizes", 'ALL') AS "Sizes", "Final_Outlet_Classification" AS outlet_class, {SUMS}, round(sum({TD}), 4) AS total_discount, round(sum({TD}) / sum({SV}) * 100, 2) AS avg_discount_pct
FROM txn GROUP BY GROUPING SETS (("Final_Outlet_Classification"), ("Sizes", "Final_Outlet_Classification"))
""")
def _(spark, sf):
    return r(P.promo_rate(txn(spark, sf, *CORE, "Final_Outlet_Classification")))


@query("subcat_month", """SELECT "Month" AS period, count(DISTINCT "Subcategory") AS subcategory_count, array_to_string(list_sort(list(DISTINCT "Subcategory")), ', ') AS subcategories FROM txn WHERE "Category" = 'PROMO' GROUP BY 1""")
def _(spark, sf):
    return P.subcat_month(txn(spark, sf, "Date", "Category", "Subcategory").where("Category = 'PROMO'"))


@query("subcat_month_metrics", f"""SELECT "Month" AS period, "Subcategory", {SUMS}, count(*) AS rows FROM txn WHERE "Category" = 'PROMO' GROUP BY ALL""")
def _(spark, sf):
    return r(P.subcat_month_metrics(txn(spark, sf, "Date", "Category", "Subcategory", P.SALES, P.QTY).where("Category = 'PROMO'")))


@query("presence_rows", """SELECT DISTINCT "Month" AS period, "Subcategory" AS subcategory FROM txn""")
def _(spark, sf):
    return P.presence_rows(txn(spark, sf, "Date", "Subcategory"))


@query("presence_matrix", """
SELECT "Month" AS period, CAST(max(CASE "Subcategory" WHEN 'RED WIDGET' THEN 1 ELSE 0 END) AS INTEGER) AS "RED WIDGET", CAST(max(CASE "Subcategory" WHEN 'BLUE BOLT' THEN 1 ELSE 0 END) AS INTEGER) AS "BLUE BOLT"
FROM txn WHERE "Category" = 'PROMO' GROUP BY 1
""")
def _(spark, sf):
    return P.presence_matrix(txn(spark, sf, "Date", "Category", "Subcategory").where("Category = 'PROMO'"), ["RED WIDGET", "BLUE BOLT"])


_FY = "'FY' || right(CAST(year(\"Date\") + CASE WHEN month(\"Date\") >= 4 THEN 1 ELSE 0 END AS VARCHAR), 2)"


@query("fy_region", f"""
SELECT {_FY} AS fy, "Sizes", round(coalesce(sum({SV}) FILTER ("Final_State" = 'NATION_3'), 0), 4) AS sales_mh, round(coalesce(sum({SV}) FILTER ("Final_State" = 'NATION_7'), 0), 4) AS sales_up, round(sum({SV}), 4) AS total_sales,
  round(coalesce(sum({Q_}) FILTER ("Final_State" = 'NATION_3'), 0), 4) AS quantity_mh, round(coalesce(sum({Q_}) FILTER ("Final_State" = 'NATION_7'), 0), 4) AS quantity_up, round(sum({Q_}), 4) AS total_quantity
FROM txn WHERE {_FY} IN ('FY99', 'FY00') AND "Date" <= DATE '1999-11-30' GROUP BY 1, 2
""")
def _(spark, sf):
    t = txn(spark, sf, *CORE, "Final_State")
    return r(P.fy_region(t, {"NATION_3": "mh", "NATION_7": "up"}, ("FY99", "FY00"), "1999-11-30"))


@query("wh_contribution", f"""
SELECT "Sizes", "Slab", round(sum({SV}), 4) AS total_sales, round(coalesce(sum({SV}) FILTER ("Final_Outlet_Classification" = 'WH'), 0), 4) AS wh_sales,
  round(coalesce(sum({SV}) FILTER ("Final_Outlet_Classification" = 'WH'), 0) / sum({SV}) * 100, 2) AS wh_contribution_pct FROM txn WHERE "Slab" <> 'slab0' GROUP BY ALL
""")
def _(spark, sf):
    return r(P.wh_contribution(txn(spark, sf, "Sizes", "Slab", "Final_Outlet_Classification", P.SALES)))


@query("wh_share_join", f"""
SELECT "Final_State", "Sizes", "Slab", round(sum({SV}), 4) AS total_sales, round(coalesce(sum({SV}) FILTER ("Final_Outlet_Classification" = 'WH'), 0), 4) AS wh_sales,
  round(coalesce(sum({SV}) FILTER ("Final_Outlet_Classification" = 'WH'), 0) / sum({SV}) * 100, 2) AS wh_share_pct FROM txn GROUP BY "Final_State", "Sizes", "Slab"
""")
def _(spark, sf):
    return r(P.wh_share(txn(spark, sf, "Final_State", "Sizes", "Slab", "Final_Outlet_Classification", P.SALES)))


@query("discount_corr", """
SELECT "Sizes", "Slab", round(corr(quantity, actual), 6) AS corr_actual_discount_pct, round(corr(quantity, store_count), 6) AS corr_store_count, round(corr(quantity, base), 6) AS corr_base_discount_pct FROM v_month GROUP BY ALL
""")
def _(spark, sf):
    return r(P.discount_corr(month_frame(spark, sf), M.GROUP, "quantity", ["actual_discount_pct", "store_count", "base_discount_pct"]), 6)


@query("slab_rules", """
SELECT "Sizes", 'slab' || i AS "Slab", CASE WHEN hi IS NULL THEN 'Qty >= ' || f(lo) ELSE f(lo) || ' <= Qty < ' || f(hi) END AS rule FROM (
  SELECT "Sizes", i, b[i] AS lo, b[i + 1] AS hi FROM (SELECT "Sizes", b, unnest(generate_series(1, len(b))) AS i FROM (
    SELECT "Sizes", list_sort(list_distinct(quantile_cont(mq, [0.25, 0.5, 0.75]))) AS b FROM (SELECT "Outlet_ID", "Month", "Sizes", sum("Quantity") AS mq FROM txn GROUP BY ALL) GROUP BY 1)))
""".replace("f(lo)", "CASE WHEN lo = floor(lo) THEN CAST(CAST(lo AS BIGINT) AS VARCHAR) ELSE CAST(lo AS VARCHAR) END").replace(
    "f(hi)", "CASE WHEN hi = floor(hi) THEN CAST(CAST(hi AS BIGINT) AS VARCHAR) ELSE CAST(hi AS VARCHAR) END"))
def _(spark, sf):
    q = S.grain_totals(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity")).groupBy("Sizes", "Monthly_Quantity").agg(F.count("*").alias("n"))
    breaks = q.groupBy("Sizes").agg(F.percentile("Monthly_Quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("breaks"))
    return P.slab_rules(breaks)


@query("mrp_dates", """
SELECT "Date", min("Date") OVER () AS first_date, max("Date") OVER () AS last_date, count(*) OVER () AS unique_dates FROM (SELECT DISTINCT "Date" FROM txn WHERE "Sizes" = '18-ML' AND "MRP" = 900.1)
""")
def _(spark, sf):
    return P.mrp_dates(txn(spark, sf, "Date", "Sizes", "MRP"), "18-ML", 900.1)


@query("price_change_months", """
SELECT "Sizes", period, count(*) AS products_changed FROM (SELECT *, lag(mrp) OVER (PARTITION BY "Sizes", "Sku_Code" ORDER BY period) AS p FROM (
  SELECT "Sizes", "Sku_Code", "Month" AS period, median(floor("MRP" + "Quantity" / 10)) AS mrp FROM txn GROUP BY ALL)) WHERE abs(mrp - p) > 1e-9 GROUP BY ALL
""")
def _(spark, sf):
    # Retail prices never change in the driver data, so a quantity-dependent price stands in.
    t = txn(spark, sf, "Date", "Sizes", "Sku_Code", "MRP", "Quantity").withColumn("MRP", F.floor(F.col("MRP") + F.col("Quantity") / 10).cast("double"))
    return P.price_change_months(t)


@query("dominant_price", """
SELECT *, lag(dominant_mrp) OVER w AS prev_mrp, round(dominant_mrp - lag(dominant_mrp) OVER w, 4) AS mrp_change FROM (
  SELECT "Sizes", period, "MRP" AS dominant_mrp, q AS total_qty FROM (SELECT "Sizes", "Month" AS period, "MRP", sum("Quantity") AS q FROM txn GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY "Sizes", period ORDER BY q DESC, "MRP") = 1) WINDOW w AS (PARTITION BY "Sizes" ORDER BY period)
""")
def _(spark, sf):
    return r(P.dominant_price(txn(spark, sf, "Date", "Sizes", "MRP", "Quantity")))


view("v_log", """
SELECT *, month(period) AS mno, avg(y) OVER (PARTITION BY "Sizes", month(period)) AS ym, avg(t) OVER (PARTITION BY "Sizes", month(period)) AS tm FROM (
  SELECT "Sizes", period, q, ln(q) AS y, (row_number() OVER (PARTITION BY "Sizes" ORDER BY period) - 1)::DOUBLE AS t FROM v_sizeq)
""")
view("v_slope", """SELECT "Sizes", sum((y - ym) * (t - tm)) / sum((t - tm) * (t - tm)) AS b, count(*) AS n, min(period) AS a, max(period) AS z FROM v_log GROUP BY 1""")


def seasonal(spark, sf):
    return P.trend_seasonality(M.month_totals(defined_days(spark, sf), ["Sizes"]), ["Sizes"], "quantity")


@query("trend_seasonality", """
SELECT s."Sizes", n AS n_months, a AS start_month, z AS end_month, round((exp(b) - 1) * 100, 5) AS monthly_growth_pct, round((exp(12 * b) - 1) * 100, 5) AS annualized_growth_pct, round(r2, 6) AS r2_log_model,
  round((exp(ts) - 1) * 100, 5) AS theilsen_monthly_growth_pct
FROM v_slope s JOIN (SELECT l."Sizes", 1 - sum(power(y - ym - b * (t - tm), 2)) / (var_pop(y) * count(*)) AS r2 FROM v_log l JOIN v_slope USING ("Sizes") GROUP BY ALL) USING ("Sizes")
JOIN (SELECT p."Sizes", median((q.y - p.y) / (q.t - p.t)) AS ts FROM v_log p JOIN v_log q ON p."Sizes" = q."Sizes" AND p.t < q.t GROUP BY 1) USING ("Sizes")
""")
def _(spark, sf):
    return r(seasonal(spark, sf)[0], 5, r2_log_model=6)


@query("seasonality_index", """
SELECT "Sizes", CAST(mno AS INTEGER) AS month_no, round(e / avg(e) OVER (PARTITION BY "Sizes"), 6) AS seasonality_index FROM (
  SELECT DISTINCT "Sizes", mno, exp(ym - b * tm) AS e FROM v_log JOIN v_slope USING ("Sizes"))
""")
def _(spark, sf):
    return r(seasonal(spark, sf)[1], 6)


@query("seasonal_fit", """SELECT "Sizes", period, round(q, 4) AS actual, round(exp(ym + b * (t - tm)), 3) AS fitted FROM v_log JOIN v_slope USING ("Sizes")""")
def _(spark, sf):
    return r(seasonal(spark, sf)[2], 3, actual=4)
