"""Slab, period, base depth and month frame queries."""

import datetime as dt

from pyspark.sql import functions as F

from tradelift.functions import columns as K
from tradelift.functions.lineage import cut
from tradelift.operators import discount as D, frame as M, scope as S, sequence as Q, sketches
from tradelift.plans.fixtures import txn
from tradelift.plans.registry import query, view
from tradelift.plans.scope import RULES
from tradelift.schema import BaseParams

BASIS = ("Date", "Outlet_ID", "Sizes", "Quantity", "Scheme_Discount", "Staggered_qps", "Basic_Rate_Per_PC_without_GST",
         "Selling_Rate_Per_PC_without_GST_CLP")
TOTALS = ("Date", "Outlet_ID", "Sizes", "Quantity", "SalesValue_atBasicRate", "TotalDiscount")


def r(df, digits=4, **special):
    """Rounds every double column, so that sums taken in another order print alike."""
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def defined_days(spark, sf, *extra):
    """Outlet days under recomputed slabs, the lowest slab left out."""
    basis = D.discount_basis(txn(spark, sf, *BASIS, *extra))
    return S.outlet_days(basis, RULES, [c for c in extra if c == "Final_State"]).where(K.allowed_slab("Slab"))


def total_days(spark, sf, *extra):
    t = txn(spark, sf, *TOTALS, "MRP", *extra).withColumn("mrp_qty", F.col("MRP") * F.col("Quantity"))
    return S.outlet_days(t, RULES, list(extra)).where(K.allowed_slab("Slab"))


def month_frame(spark, sf, *extra):
    return M.month_model_frame(defined_days(spark, sf, *extra), [*extra, *M.GROUP])


def other_frame(spark, sf, *extra):
    return M.other_slabs_discount(month_frame(spark, sf, *extra), [*extra, "Sizes"])


def hysteresis_views(name, source, keys, order, value):
    """Oracle for the carried base: <name>_n numbers the rows, <name> walks them recursively."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    on = " AND ".join([f"m.{x} = b.{x}" for x in keys] + ["m.rn = b.rn + 1"])
    view(name + "_n", f"SELECT *, {value} AS r, row_number() OVER ({part} ORDER BY {order}) AS rn FROM {source}")
    view(name, f"""
SELECT {k + ',' if k else ''} {order}, rn, coalesce(r, 0.0) AS base, FALSE AS moved FROM {name}_n WHERE rn = 1
UNION ALL
SELECT {', '.join('m.' + x for x in keys) + ',' if keys else ''} m.{order}, m.rn,
  CASE WHEN m.r IS NULL OR (m.r > b.base AND m.r - b.base < 1) OR (m.r < b.base AND b.base - m.r < 1) THEN b.base ELSE m.r END,
  NOT (m.r IS NULL OR (m.r > b.base AND m.r - b.base < 1) OR (m.r < b.base AND b.base - m.r < 1)) AND abs(m.r - b.base) > 1e-9
FROM {name} b JOIN {name}_n m ON {on}
""")


G = ['"Sizes"', '"Slab"']
view("v_tb", """SELECT *, "Scheme_Discount" + "Staggered_qps" AS scheme, "Quantity" * "DSP" AS dsp_amt, "Quantity" * "CLP" AS clp_amt FROM txn""")
view("v_db", """SELECT *, "Scheme_Discount" + "Staggered_qps" AS scheme, "Quantity" * "DSP" AS dsp_amt, "Quantity" * "CLP" AS clp_amt FROM v_defined""")
view("v_m0", """
SELECT "Sizes", "Slab", "Month" AS period, count(DISTINCT "Outlet_ID") AS store_count, sum("Quantity") AS quantity, sum(scheme) AS total_discount,
       sum(dsp_amt) AS sales_value, sum(scheme) / sum(dsp_amt) * 100 AS actual FROM v_db WHERE "Slab" <> 'slab0' GROUP BY ALL
""")
hysteresis_views("v_mb", "v_m0", G, "period", "round_even(actual / 0.5, 0) * 0.5")
view("v_month", """
SELECT m.*, b.base, greatest(actual - b.base, 0) AS tactical, coalesce(lag(b.base) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period), b.base) AS lag1,
       sales_value / quantity AS base_price
FROM v_m0 m JOIN v_mb b USING ("Sizes", "Slab", period)
""")
view("v_other", """
SELECT m.*, coalesce(last_value(o.other IGNORE NULLS) OVER w, first_value(o.other IGNORE NULLS) OVER v, 0) AS other
FROM v_month m LEFT JOIN (
  SELECT a."Sizes", a."Slab", b.period, sum(b.base * w.q / w.rest) AS other
  FROM (SELECT DISTINCT "Sizes", "Slab" FROM v_month) a
  JOIN v_month b ON a."Sizes" = b."Sizes" AND a."Slab" <> b."Slab"
  JOIN (SELECT x."Sizes", x."Slab" AS own, y."Slab" AS oth, y.q, sum(y.q) OVER (PARTITION BY x."Sizes", x."Slab") AS rest
        FROM (SELECT "Sizes", "Slab" FROM v_month GROUP BY ALL) x
        JOIN (SELECT "Sizes", "Slab", sum(quantity) AS q FROM v_month GROUP BY ALL) y ON x."Sizes" = y."Sizes" AND x."Slab" <> y."Slab") w
    ON w."Sizes" = a."Sizes" AND w.own = a."Slab" AND w.oth = b."Slab"
  GROUP BY ALL) o USING ("Sizes", "Slab", period)
WINDOW w AS (PARTITION BY m."Sizes", m."Slab" ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       v AS (PARTITION BY m."Sizes", m."Slab" ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""")
# Day blocks over the slabs as given.
view("v_day", """
SELECT "Sizes", "Slab", "Date" AS period, "Month" AS month, count(DISTINCT "Bill_No") AS orders, sum("Quantity") AS quantity, sum(scheme) AS total_discount,
       sum(dsp_amt) AS sales_value, sum(scheme) / sum(dsp_amt) * 100 AS actual FROM v_tb WHERE "Slab" <> 'slab0' GROUP BY ALL
""")
view("v_fence", """
SELECT *, CASE WHEN n >= 8 AND hi > lo AND (v < lo - 1.5 * (hi - lo) OR v > hi + 1.5 * (hi - lo)) THEN NULL ELSE v END AS kept FROM (
  SELECT *, count(*) OVER p AS n, quantile_cont(v, 0.25) OVER p AS lo, quantile_cont(v, 0.75) OVER p AS hi,
         row_number() OVER (PARTITION BY "Sizes", "Slab", month ORDER BY period) AS pos
  FROM (SELECT *, round_even(actual / 0.5, 0) * 0.5 AS v FROM v_day) WINDOW p AS (PARTITION BY "Sizes", "Slab", month))
""")
view("v_cand", """
SELECT "Sizes", "Slab", month, least(median(kept) FILTER (pos <= 10), median(kept) FILTER (pos BETWEEN 11 AND 20), median(kept) FILTER (pos > 20)) AS cand
FROM v_fence GROUP BY ALL
""")
hysteresis_views("v_bb", "v_cand", G, "month", "cand")


@query("slab_summary", """
SELECT "Sizes", "Slab", count(DISTINCT "Outlet_ID") AS outlets, count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date") AS invoices, round(sum("Quantity"), 4) AS quantity,
  round(sum(dsp_amt), 4) AS sales_value, round(sum(scheme), 4) AS total_discount, min("Quantity") AS min_qty, max("Quantity") AS max_qty,
  round(avg("Quantity"), 2) AS aoq, round(sum(dsp_amt) / count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date"), 2) AS aov,
  round(sum(scheme) / sum(dsp_amt) * 100, 2) AS discount_pct,
  "Slab" || CASE WHEN min("Quantity") = max("Quantity") THEN ' (Qty=' || CAST(CAST(min("Quantity") AS BIGINT) AS VARCHAR) ELSE ' (Qty ' || CAST(CAST(min("Quantity") AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(max("Quantity") AS BIGINT) AS VARCHAR) END || ')' AS slab_label,
  round(count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date") * 100.0 / sum(count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date")) OVER (), 2) AS invoice_contribution_pct,
  round(sum(dsp_amt) * 100.0 / sum(sum(dsp_amt)) OVER (), 2) AS sales_contribution_pct
FROM v_tb GROUP BY "Sizes", "Slab"
""")
def _(spark, sf):
    return r(D.slab_summary(D.discount_basis(txn(spark, sf, *BASIS, "Bill_No", "Slab"))))


@query("approx_slab_summary", """
SELECT "Sizes", "Slab", count(DISTINCT "Outlet_ID") AS outlets, count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date") AS invoices, round(sum("Quantity"), 4) AS quantity,
  round(sum(dsp_amt), 4) AS sales_value, TRUE AS outlets_within, TRUE AS invoices_within
FROM v_tb GROUP BY "Sizes", "Slab"
""")
def _(spark, sf):
    basis = D.discount_basis(txn(spark, sf, *BASIS, "Bill_No", "Slab"))
    near = D.slab_summary(basis, lg_k=sketches.LG_K).select("Sizes", "Slab", F.col("outlets").alias("o"), F.col("invoices").alias("i"), "quantity", "sales_value")
    both = D.slab_summary(basis).select("Sizes", "Slab", "outlets", "invoices").join(near, ["Sizes", "Slab"])
    return r(both.select("Sizes", "Slab", "outlets", "invoices", "quantity", "sales_value",
                         sketches.within("o", "outlets").alias("outlets_within"), sketches.within("i", "invoices").alias("invoices_within")))


@query("merged_month_sketches", """
SELECT "Sizes", count(*) AS rows, count(DISTINCT "Outlet_ID") AS outlets, TRUE AS within, TRUE AS same
FROM txn WHERE "Date" >= DATE '1994-03-01' AND "Date" < DATE '1996-08-01' GROUP BY 1
""")
def _(spark, sf):
    t = txn(spark, sf, "Date", "Sizes", "Outlet_ID")
    months = cut(sketches.month_sketches(t, {"o": "Outlet_ID"}, ["Sizes"]))
    near = sketches.merged(months, ["o"], ["Sizes"], dt.date(1994, 3, 1), dt.date(1996, 7, 1))
    whole = t.where("Date >= DATE '1994-03-01' AND Date < DATE '1996-08-01'").groupBy("Sizes").agg(
        F.count_distinct("Outlet_ID").alias("outlets"), sketches.estimate("Outlet_ID").alias("w"))
    return near.join(whole, "Sizes").select("Sizes", "rows", "outlets", sketches.within("o", "outlets").alias("within"), (F.col("o") == F.col("w")).alias("same"))


@query("slab_label", """
SELECT "Slab", "Slab" || ' (Qty ' || CAST(CAST(min("Quantity") AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(max("Quantity") AS BIGINT) AS VARCHAR) || ')' AS label FROM v_defined GROUP BY 1
""")
def _(spark, sf):
    t = S.assign_slabs(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity"), RULES)
    return t.groupBy("Slab").agg(F.min("Quantity").alias("min_qty"), F.max("Quantity").alias("max_qty")).select("Slab", D.slab_label().alias("label"))


@query("state_summary", """
SELECT "Final_State", count(DISTINCT "Outlet_ID") AS outlets, count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date") AS invoices, round(sum("Quantity"), 4) AS quantity,
  round(sum("SalesValue_atBasicRate"), 4) AS sales_value, round(sum("TotalDiscount"), 4) AS total_discount, round(avg("Quantity"), 2) AS aoq,
  round(sum("SalesValue_atBasicRate") / count(DISTINCT "Outlet_ID" || '|' || "Bill_No" || '|' || "Date"), 2) AS aov,
  round(sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100, 2) AS discount_pct
FROM txn GROUP BY 1
""")
def _(spark, sf):
    return r(D.state_summary(txn(spark, sf, "Final_State", "Outlet_ID", "Bill_No", "Date", "Quantity", "SalesValue_atBasicRate", "TotalDiscount")))


_ROLL = """
SELECT '{0}' AS grain, CAST(date_trunc('{1}', "Date") AS DATE) AS period, count(DISTINCT "Bill_No") AS orders, count(DISTINCT "Outlet_ID") AS store_count,
  round(sum("Quantity"), 4) AS quantity, round(sum("Net_Amt"), 4) AS net_amt, round(sum("TotalDiscount"), 4) AS total_discount,
  round(sum("SalesValue_atBasicRate"), 4) AS sales_value, round(sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100, 6) AS discount_pct,
  CAST(round(CAST(sum("SalesValue_atBasicRate") / sum("Quantity") AS DECIMAL(38,10)), 6) AS DOUBLE) AS base_price FROM txn GROUP BY 2
"""


@query("period_rollup", " UNION ALL ".join(_ROLL.format(g, w) for g, w in (("D", "day"), ("W", "week"), ("M", "month"))))
def _(spark, sf):
    t = txn(spark, sf, "Date", "Bill_No", "Outlet_ID", "Quantity", "Net_Amt", "TotalDiscount", "SalesValue_atBasicRate")
    parts = [D.period_rollup(t, g).select(F.lit(g).alias("grain"), "*") for g in "DWM"]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return r(both.withColumn("base_price", K.half_up("base_price", 6, 10)), discount_pct=6, base_price=6)


@query("outlet_periods", """
SELECT *, count(*) OVER w AS periods, round(sum(quantity) OVER w, 4) AS outlet_quantity, round(sum(net_amt) OVER w, 4) AS outlet_net,
  round(sum(total_discount) OVER w / sum(sales_value) OVER w * 100, 6) AS outlet_discount_pct FROM (
  SELECT "Outlet_ID", "Month" AS period, count(DISTINCT "Bill_No") AS orders, round(sum("Quantity"), 4) AS quantity, round(sum("Net_Amt"), 4) AS net_amt,
    round(sum("TotalDiscount"), 4) AS total_discount, round(sum("SalesValue_atBasicRate"), 4) AS sales_value,
    round(sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100, 6) AS discount_pct,
    round(round_even(sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100 / 0.5, 0) * 0.5, 2) AS discount_pct_display FROM txn GROUP BY ALL)
WINDOW w AS (PARTITION BY "Outlet_ID")
""")
def _(spark, sf):
    t = txn(spark, sf, "Date", "Bill_No", "Outlet_ID", "Quantity", "Net_Amt", "TotalDiscount", "SalesValue_atBasicRate")
    return r(D.outlet_periods(t, "M"), discount_pct=6, discount_pct_display=2, outlet_discount_pct=6)


@query("discount_basis", """
SELECT "Month", round(sum(scheme), 4) AS scheme, round(sum(dsp_amt), 4) AS dsp, round(sum(clp_amt), 4) AS clp FROM v_tb GROUP BY 1
""")
def _(spark, sf):
    # The preferred unit price is zero in every row, so the second one is used.
    t = txn(spark, sf, *BASIS).withColumnRenamed("Basic_Rate_Per_PC_without_GST", "Basic_Rate_Per_PC").withColumn(
        "Basic_Rate_Per_PC_without_GST", F.lit(0.0))
    return r(D.discount_basis(t).groupBy(K.month_of("Date").alias("Month")).agg(
        F.sum("scheme_amount").alias("scheme"), F.sum("dsp_sales").alias("dsp"), F.sum("clp_sales").alias("clp")))


@query("daily_discount", """
SELECT "Sizes", "Slab", period, orders, round(quantity, 4) AS quantity, round(total_discount, 4) AS total_discount, round(sales_value, 4) AS sales_value,
  round(actual, 6) AS actual_discount_pct FROM v_day
""")
def _(spark, sf):
    b = D.discount_basis(txn(spark, sf, *BASIS, "Bill_No", "Slab").where(K.allowed_slab("Slab")))
    return r(D.daily_discount(b, M.GROUP), actual_discount_pct=6)


@query("base_depth_points", """
SELECT 'data' AS mode, p.*, round(base, 2) AS base_discount_pct, round(greatest(act - base, 0), 6) AS tactical_discount_pct FROM (
  SELECT "Sizes", "Slab", w AS period, sum(orders)::BIGINT AS orders, round(sum(quantity), 4) AS quantity, round(sum(total_discount), 4) AS total_discount,
    round(sum(sales_value), 4) AS sales_value, round(sum(total_discount) / sum(sales_value) * 100, 6) AS actual_discount_pct
  FROM (SELECT *, CAST(date_trunc('week', period) AS DATE) AS w FROM v_day) GROUP BY ALL) p
JOIN (SELECT d."Sizes", d."Slab", CAST(date_trunc('week', d.period) AS DATE) AS period, arg_min(base, d.period) AS base,
        sum(total_discount) / sum(sales_value) * 100 AS act
      FROM v_day d JOIN v_bb b ON d."Sizes" = b."Sizes" AND d."Slab" = b."Slab" AND d.month = b.month GROUP BY ALL) USING ("Sizes", "Slab", period)
UNION ALL BY NAME
SELECT 'define' AS mode, "Sizes", "Slab", period, o.orders, round(quantity, 4) AS quantity, round(total_discount, 4) AS total_discount, round(sales_value, 4) AS sales_value,
  round(actual, 6) AS actual_discount_pct, round(base, 2) AS base_discount_pct, round(tactical, 6) AS tactical_discount_pct, NULL AS base, NULL AS act
FROM v_month JOIN (SELECT "Sizes", "Slab", "Month" AS period, sum(n)::BIGINT AS orders FROM (SELECT "Sizes", "Slab", "Month", "Date", count(DISTINCT "Bill_No") AS n FROM v_db GROUP BY ALL) GROUP BY ALL) o USING ("Sizes", "Slab", period)
""".replace("p.*, round(base, 2)", "p.*, NULL AS act_, round(base, 2)").replace("NULL AS act_, ", "").replace(", NULL AS base, NULL AS act\n", "\n"))
def _(spark, sf):
    t = txn(spark, sf, *BASIS, "Bill_No", "Slab")
    given = D.discount_basis(t.where(K.allowed_slab("Slab")))
    weekly = D.base_depth_points(given, M.GROUP, BaseParams(mode="data", grain="W"))
    defined = D.discount_basis(S.assign_slabs(t.drop("Slab"), RULES).where(K.allowed_slab("Slab")))
    monthly = D.base_depth_points(defined, M.GROUP, BaseParams(mode="define"))
    both = weekly.select(F.lit("data").alias("mode"), "*").unionByName(monthly.select(F.lit("define").alias("mode"), "*"))
    return r(both, actual_discount_pct=6, base_discount_pct=2, tactical_discount_pct=6)


@query("base_depth_summary", """
SELECT "Sizes", "Slab", count(*) AS periods, round(avg(actual), 6) AS avg_actual_discount_pct, round(avg(base), 6) AS avg_base_discount_pct, round(avg(tactical), 6) AS avg_tactical_discount_pct,
  round(max(actual), 6) AS max_actual_discount_pct, round(max(base), 6) AS max_base_discount_pct FROM v_month GROUP BY ALL
""")
def _(spark, sf):
    return r(D.base_depth_summary(month_frame(spark, sf), M.GROUP), 6)


_FRAME = """"Sizes", "Slab", period, store_count, round(quantity, 4) AS quantity, round(total_discount, 4) AS total_discount, round(sales_value, 4) AS sales_value,
  round(actual, 6) AS actual_discount_pct, round(base, 6) AS base_discount_pct, round(tactical, 6) AS tactical_discount_pct, round(lag1, 6) AS lag1_base_discount_pct, CAST(round(CAST(base_price AS DECIMAL(38,10)), 6) AS DOUBLE) AS base_price"""
_P6 = {c: 6 for c in ("actual_discount_pct", "base_discount_pct", "tactical_discount_pct", "lag1_base_discount_pct", "base_price")}


@query("month_model_frame", f"SELECT {_FRAME} FROM v_month")
def _(spark, sf):
    m = month_frame(spark, sf).drop("clp_sales")
    return r(m.withColumn("base_price", K.half_up("base_price", 6, 10)), **_P6)


@query("base_to_month", f"""
SELECT "Sizes", "Slab", m.period, store_count, round(quantity, 4) AS quantity, round(total_discount, 4) AS total_discount, round(sales_value, 4) AS sales_value,
  round(actual, 6) AS actual_discount_pct, round(b.base, 6) AS base_discount_pct
FROM (SELECT "Sizes", "Slab", "Month" AS period, count(DISTINCT "Outlet_ID") AS store_count, sum("Quantity") AS quantity, sum(scheme) AS total_discount, sum(dsp_amt) AS sales_value,
        sum(scheme) / sum(dsp_amt) * 100 AS actual FROM v_tb WHERE "Slab" <> 'slab0' GROUP BY ALL) m
JOIN (SELECT "Sizes", "Slab", month AS period, base FROM v_bb) b USING ("Sizes", "Slab", period)
""")
def _(spark, sf):
    od = S.outlet_days(D.discount_basis(txn(spark, sf, *BASIS, "Slab").where(K.allowed_slab("Slab"))), S.SlabRules())
    m = M.month_model_frame(od, M.GROUP, BaseParams(mode="data"))
    return r(m.drop("clp_sales", "tactical_discount_pct", "lag1_base_discount_pct", "base_price"), **_P6)


@query("other_slabs_discount", """SELECT "Sizes", "Slab", period, round(other, 6) AS other_slabs_weighted_base_discount_pct FROM v_other""")
def _(spark, sf):
    return r(other_frame(spark, sf).select("Sizes", "Slab", "period", "other_slabs_weighted_base_discount_pct"), 6)


view("v_weights", """
SELECT "Sizes", "Slab", q / sum(q) OVER (PARTITION BY "Sizes") AS weight FROM (SELECT "Sizes", "Slab", sum("Quantity") AS q FROM v_defined WHERE "Slab" <> 'slab0' GROUP BY ALL)
""")


@query("slab_weights", """SELECT "Sizes", "Slab", round(weight, 8) AS weight, 'modeled' AS weight_source FROM v_weights""")
def _(spark, sf):
    t = S.assign_slabs(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity"), RULES).where(K.allowed_slab("Slab"))
    return r(M.slab_weights(t), 8)


view("v_t0", """
SELECT "Sizes", "Slab", "Month" AS period, sum("Quantity") AS quantity, sum("TotalDiscount") AS td, sum("SalesValue_atBasicRate") AS sv,
       sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100 AS actual, sum("MRP" * "Quantity") AS mq_, count(DISTINCT "Outlet_ID") AS stores
FROM v_defined WHERE "Slab" <> 'slab0' GROUP BY ALL
""")
hysteresis_views("v_tbase", "v_t0", G, "period", "round_even(actual / 0.5, 0) * 0.5")
view("v_btab", """
SELECT t."Sizes", t."Slab", t.period, quantity, round(actual, 2) AS actual, round(b.base, 2) AS base,
       q / tot AS fixed_weight
FROM v_t0 t JOIN v_tbase b USING ("Sizes", "Slab", period)
JOIN (SELECT "Sizes", "Slab", sum(quantity) AS q, sum(sum(quantity)) OVER (PARTITION BY "Sizes") AS tot FROM v_t0 GROUP BY 1, 2) USING ("Sizes", "Slab")
""")


@query("weighted_discount_detail", """
SELECT "Sizes", "Slab", period, round(fixed_weight, 6) AS fixed_weight, round(fixed_weight * base, 6) AS weighted_base, round(fixed_weight * actual, 6) AS weighted_actual,
  round(sum(fixed_weight * base) OVER w, 6) AS month_base, round(sum(fixed_weight * actual) OVER w, 6) AS month_actual FROM v_btab WINDOW w AS (PARTITION BY "Sizes", period)
""")
def _(spark, sf):
    d = M.weighted_discount_detail(M.base_discount_table(total_days(spark, sf)))
    return r(d.select("Sizes", "Slab", "period", "fixed_weight", "weighted_base", "weighted_actual", "month_base", "month_actual"), 6)


@query("base_summary", """
SELECT "Sizes", "Slab", count(DISTINCT period) AS months, round(avg(actual), 2) AS avg_actual, round(avg(base), 2) AS avg_base, round(sum(quantity), 4) AS quantity,
  round(sum(quantity) / sum(sum(quantity)) OVER (PARTITION BY "Sizes") * 100, 2) AS quantity_pct FROM v_btab GROUP BY 1, 2
""")
def _(spark, sf):
    return r(M.base_summary(M.base_discount_table(total_days(spark, sf))))


def metric_views(name, by):
    """Month metrics per column: <name>0 sums, <name>b the carried base."""
    key = f'"{by}", ' if by else ""
    view(name + "0", f"""SELECT {key}"Month" AS period, sum("SalesValue_atBasicRate") AS sales, sum("Quantity") AS volume, sum("TotalDiscount") AS discount,
      sum("MRP" * "Quantity") AS mv, sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100 AS level FROM txn GROUP BY ALL""")
    hysteresis_views(name + "b", name + "0", [f'"{by}"'] if by else [], "period", "round_even(level / 0.5, 0) * 0.5")


metric_views("v_mm", "")
metric_views("v_ms", "Sizes")
_METRIC = """SELECT '{g}' AS by_column, {v} AS by_value, period, round(sales, 4) AS sales, round(volume, 4) AS volume, round(discount, 4) AS discount, round(level, 6) AS discount_level_pct,
  round(base, 6) AS base_discount_pct, round(sales / volume, 6) AS base_price, round(mv / volume, 6) AS mrp,
  round((sales / lag(sales) OVER ({p} ORDER BY period) - 1) * 100, 6) AS sales_growth_pct, round((volume / lag(volume) OVER ({p} ORDER BY period) - 1) * 100, 6) AS volume_growth_pct
FROM {n}0 JOIN {n}b USING ({u}period)"""


@query("month_metrics", _METRIC.format(g="all", v="'all'", p="", n="v_mm", u="") + " UNION ALL " + _METRIC.format(
    g="Sizes", v='"Sizes"', p='PARTITION BY "Sizes"', n="v_ms", u='"Sizes", '))
def _(spark, sf):
    t = txn(spark, sf, "Date", "Sizes", "Quantity", "SalesValue_atBasicRate", "TotalDiscount", "MRP")
    whole = M.month_metrics(t).select(F.lit("all").alias("by_column"), F.lit("all").alias("by_value"), "*")
    sizes = M.month_metrics(t, ["Sizes"])
    sizes = sizes.select(F.lit("Sizes").alias("by_column"), F.col("Sizes").alias("by_value"), *[c for c in sizes.columns if c != "Sizes"])
    six = {c: 6 for c in whole.columns if c.endswith("_pct") or c in ("base_price", "mrp")}
    return r(whole.unionByName(sizes), **six)


# Sequence operators on month and day series.
@query("lag_base", """SELECT "Sizes", "Slab", period, round(base, 6) AS base_discount_pct, round(lag1, 6) AS lag1_base_discount_pct FROM v_month""")
def _(spark, sf):
    m = month_frame(spark, sf).select("Sizes", "Slab", "period", "base_discount_pct")
    return r(Q.lag_base(m, M.GROUP, "period"), 6)


@query("pct_change", """
SELECT "Sizes", "Slab", period, round(coalesce((quantity / lag(quantity) OVER w - 1) * 100, 0), 6) AS quantity_change_pct,
  round(coalesce((sales_value / lag(sales_value) OVER w - 1) * 100, 0), 6) AS sales_change_pct FROM v_m0 WINDOW w AS (PARTITION BY "Sizes", "Slab" ORDER BY period)
""")
def _(spark, sf):
    m = M.month_totals(defined_days(spark, sf))
    c = Q.pct_change(m, M.GROUP, "period", {"quantity": "quantity_change_pct", "sales_value": "sales_change_pct"})
    return r(c.select("Sizes", "Slab", "period", "quantity_change_pct", "sales_change_pct"), 6)


view("v_holes", """SELECT "Sizes", "Slab", period, CASE WHEN month(period) % 5 <> 0 AND actual < 9.2 THEN actual END AS v FROM v_m0""")


def holes(spark, sf):
    m = M.month_totals(defined_days(spark, sf))
    return m.select("Sizes", "Slab", "period", F.when((F.month("period") % 5 != 0) & (F.col("actual_discount_pct") < 9.2), F.col("actual_discount_pct")).alias("v"))


@query("fill_gaps", """
SELECT "Sizes", "Slab", period, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM v_holes
""")
def _(spark, sf):
    return r(Q.fill_gaps(holes(spark, sf), M.GROUP, "period", ["v"]), 6)


@query("interpolate", """
SELECT "Sizes", "Slab", period, round(coalesce(v, a.x + (b.x - a.x) * (i - a.i) / nullif(b.i - a.i, 0), a.x, b.x), 6) AS filled FROM (
  SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first_value(k IGNORE NULLS) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT *, CASE WHEN v IS NOT NULL THEN {'i': i, 'x': v} END AS k FROM (SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) AS i FROM v_holes)))
""")
def _(spark, sf):
    return r(Q.interpolate(holes(spark, sf), M.GROUP, "period", "v", "filled").select("Sizes", "Slab", "period", "filled"), 6)


def rounded_days(spark, sf):
    b = D.discount_basis(txn(spark, sf, *BASIS, "Bill_No", "Slab").where(K.allowed_slab("Slab")))
    return D.daily_discount(b, M.GROUP).withColumn("month", K.month_of("period")).withColumn("v", K.round_step("actual_discount_pct", 0.5))


@query("iqr_fence", """SELECT "Sizes", "Slab", month, count(*) AS days, count(kept) AS kept_days, round(sum(kept), 4) AS kept_sum FROM v_fence GROUP BY ALL""")
def _(spark, sf):
    f = Q.iqr_fence(rounded_days(spark, sf), [*M.GROUP, "month"], "v", "kept")
    return r(f.groupBy("Sizes", "Slab", "month").agg(F.count("*").alias("days"), F.count("kept").alias("kept_days"), F.sum("kept").alias("kept_sum")))


@query("segment_median_min", """SELECT "Sizes", "Slab", month, round(cand, 4) AS candidate FROM v_cand""")
def _(spark, sf):
    keys = [*M.GROUP, "month"]
    return r(Q.segment_median_min(Q.iqr_fence(rounded_days(spark, sf), keys, "v", "kept"), keys, "period", "kept"))


@query("base_hysteresis", """SELECT "Sizes", "Slab", month, round(least(greatest(base, 0), 100), 4) AS base_discount_pct, moved FROM v_bb""")
def _(spark, sf):
    keys = [*M.GROUP, "month"]
    c = Q.segment_median_min(Q.iqr_fence(rounded_days(spark, sf), keys, "v", "kept"), keys, "period", "kept")
    return r(Q.base_hysteresis(c, M.GROUP, "month", "candidate", moved="moved").select("Sizes", "Slab", "month", "base_discount_pct", "moved"))


view("v_regime", """
SELECT *, row_number() OVER (PARTITION BY "Sizes", "Slab", regime_id ORDER BY period) AS hold FROM (
SELECT *, sum(CASE WHEN abs(level - prev) > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) AS regime_id FROM (
  SELECT *, lag(level) OVER (PARTITION BY "Sizes", "Slab" ORDER BY period) AS prev FROM (
    SELECT *, round_even(base / 0.5, 0) * 0.5 AS level FROM v_month)))
""")


@query("regime_islands", """
SELECT "Sizes", "Slab", regime_id::BIGINT AS regime_id, min(period) AS start_period, max(period) AS end_period, count(*) AS months, round(min(level), 4) AS level FROM v_regime GROUP BY ALL
""")
def _(spark, sf):
    return r(Q.regime_islands(month_frame(spark, sf), M.GROUP, "period"))


view("v_rb0", """
SELECT "Sizes", "Slab", period, actual, row_number() OVER w AS rn, quantile_cont(actual, 0.35) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS cand,
  list(actual) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS fut FROM v_m0 WINDOW w AS (PARTITION BY "Sizes", "Slab" ORDER BY period)
""")
view("v_rb", """
SELECT "Sizes", "Slab", 0::BIGINT AS rn, cand AS base, NULL::BIGINT AS last, FALSE AS moved FROM v_rb0 WHERE rn = 12
UNION ALL
SELECT "Sizes", "Slab", rn, CASE WHEN jump THEN cand ELSE base + greatest(-0.15, least(0.15, cand - base)) END, CASE WHEN jump THEN rn ELSE last END, jump FROM (
  SELECT m."Sizes", m."Slab", m.rn, m.cand, b.base, b.last, len(fut) >= 8 AND m.rn - coalesce(b.last, -11) >= 12 AND (
    (cand >= b.base + 0.2 AND len(list_filter(fut, lambda x: x >= b.base + 0.2 * 0.6)) >= ceil(len(fut) * 0.6)) OR
    (cand <= b.base - 0.2 AND len(list_filter(fut, lambda x: x <= b.base - 0.2 * 0.6)) >= ceil(len(fut) * 0.6))) AS jump
  FROM v_rb b JOIN v_rb0 m ON m."Sizes" = b."Sizes" AND m."Slab" = b."Slab" AND m.rn = b.rn + 1)
""")


@query("rolling_base", """
SELECT "Sizes", "Slab", period, round(actual, 6) AS actual_discount_pct, round(least(greatest(base, 0), 100), 6) AS base, moved FROM v_rb JOIN v_rb0 USING ("Sizes", "Slab", rn)
""")
def _(spark, sf):
    m = M.month_totals(defined_days(spark, sf)).select("Sizes", "Slab", "period", "actual_discount_pct")
    return r(Q.rolling_base(m, M.GROUP, "period", "actual_discount_pct", up=0.2, down=0.2), 6)


@query("latest_per_group", """
SELECT "Sizes", "Slab", max(period) AS period, round(arg_max(quantity, period), 4) AS quantity, round(arg_max(base, period), 4) AS base_discount_pct, round(arg_max(base_price, period), 4) AS base_price FROM v_month GROUP BY ALL
""")
def _(spark, sf):
    m = month_frame(spark, sf).select("Sizes", "Slab", "period", "quantity", "base_discount_pct", "base_price")
    return r(Q.latest_per_group(m, M.GROUP, "period"))


@query("top_k_per_group", """
SELECT "Final_State", "Sku_Code", sales, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "Final_State" ORDER BY sales DESC, "Sku_Code") AS rn FROM (
  SELECT "Final_State", "Sku_Code", round(sum("SalesValue_atBasicRate"), 4) AS sales FROM txn GROUP BY ALL)) WHERE rn <= 3
""")
def _(spark, sf):
    t = txn(spark, sf, "Final_State", "Sku_Code", "SalesValue_atBasicRate").groupBy("Final_State", "Sku_Code").agg(
        F.round(F.sum("SalesValue_atBasicRate"), 4).alias("sales"))
    return Q.top_k_per_group(t, ["Final_State"], "sales", 3, ["Sku_Code"])


@query("trailing_series", """
SELECT "Sizes", "Slab", CAST(idx AS INTEGER) AS idx, round(base, 4) AS base_discount_pct FROM (
  SELECT *, 2 - (row_number() OVER (PARTITION BY "Sizes", "Slab" ORDER BY period DESC) - 1) AS idx FROM v_month) WHERE idx >= 0
""")
def _(spark, sf):
    return r(Q.trailing_series(month_frame(spark, sf), M.GROUP, "period", "base_discount_pct", 3))


@query("expanding_moments", """
SELECT "Sizes", "Slab", period, CAST(count(*) OVER w AS DOUBLE) AS m_n, round(sum(base) OVER w, 4) AS m_x0, round(sum(quantity) OVER w, 4) AS m_y, round(sum(base * base) OVER w, 4) AS m_xx0_0,
  round(sum(base * quantity) OVER w, 4) AS m_xy0, round(sum(quantity * quantity) OVER w, 4) AS m_yy FROM v_month
WINDOW w AS (PARTITION BY "Sizes", "Slab" ORDER BY period)
""")
def _(spark, sf):
    m = month_frame(spark, sf).select("Sizes", "Slab", "period", "quantity", "base_discount_pct")
    e = Q.expanding_moments(m, M.GROUP, "period", "quantity", ["base_discount_pct"])
    return r(e.select("Sizes", "Slab", "period", "m_n", "m_x0", "m_y", "m_xx0_0", "m_xy0", "m_yy"))


@query("month_union", """SELECT DISTINCT "Month" AS period FROM txn WHERE "Sizes" = '12-ML' AND "Slab" = 'slab1' UNION SELECT DISTINCT "Month" FROM txn WHERE "Sizes" = '18-ML'""")
def _(spark, sf):
    t = txn(spark, sf, "Date", "Sizes", "Slab").withColumn("period", K.month_of("Date"))
    return t.where("Sizes = '12-ML' AND Slab = 'slab1'").select("period").distinct().union(
        t.where("Sizes = '18-ML'").select("period").distinct()).distinct()


@query("legacy_slab_base", """SELECT "Slab", CASE "Slab" WHEN 'slab0' THEN 8.0::DOUBLE WHEN 'slab1' THEN 11.0::DOUBLE ELSE 14.0::DOUBLE END AS base, count(*) AS n FROM txn GROUP BY ALL""")
def _(spark, sf):
    return txn(spark, sf, "Slab").groupBy("Slab").agg(F.count("*").alias("n")).withColumn("base", D.legacy_slab_base())
