"""Segmentation queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from tradelift.functions import columns as K
from tradelift.functions.lineage import cut
from tradelift.operators import ranking, rfm as R, sketches
from tradelift.plans.fixtures import txn
from tradelift.plans.registry import query, view
from tradelift.schema import RfmParams

PARAMS = RfmParams(recency_days=180, frequency_threshold=10)
STATES = ("NATION_3", "NATION_17")
FACT = ("Outlet_ID", "Date", "Bill_No", "Final_State", "Net_Amt", "SalesValue_atBasicRate")


def outlets(spark, sf):
    return R.rfm_outlets(txn(spark, sf, *FACT), PARAMS)


view("v_orders", """
SELECT "Outlet_ID", "Date", "Bill_No", "Final_State", sum("Quantity") AS q, sum("Net_Amt") AS net
FROM txn WHERE "Outlet_ID" IS NOT NULL AND "Date" IS NOT NULL AND "Bill_No" IS NOT NULL
  AND "Final_State" IS NOT NULL GROUP BY ALL
""")
view("v_rf", """
SELECT "Outlet_ID", "Final_State", min("Date") AS first_order, max("Date") AS last_order,
       count(DISTINCT "Date") AS unique_order_days, count("Bill_No") AS orders_count, avg(net) AS aov,
       date_diff('day', max("Date"), (SELECT max("Date") FROM txn)) AS recency_days,
       date_diff('day', min("Date"), max("Date")) + 1 AS active_days
FROM v_orders GROUP BY 1, 2
""")
view("v_cut", """
SELECT (lm + rm) / 2 AS threshold FROM (
  SELECT x, ls / ln AS lm, (ts - ls) / (tn - ln) AS rm, ln, tn FROM (
    SELECT x, sum(n) OVER (ORDER BY x) AS ln, sum(n * x) OVER (ORDER BY x) AS ls,
           sum(n) OVER () AS tn, sum(n * x) OVER () AS ts
    FROM (SELECT ln(1 + aov) AS x, count(*) AS n FROM v_rf GROUP BY 1)) WHERE ln < tn)
ORDER BY ln * (tn - ln) * (rm - lm) * (rm - lm) DESC, x LIMIT 1
""")
view("v_rfm", """
SELECT r.*, orders_count / active_days AS orders_per_day,
       CASE WHEN recency_days <= 180 THEN 'Recent' ELSE 'Stale' END AS r_label,
       CASE WHEN unique_order_days >= 10 THEN 'High' ELSE 'Low' END AS f_label,
       CASE WHEN ln(1 + aov) > threshold THEN 'High' ELSE 'Low' END AS m_label,
       CASE WHEN recency_days <= 180 THEN 'Recent' ELSE 'Stale' END || '-' ||
       CASE WHEN unique_order_days >= 10 THEN 'High' ELSE 'Low' END || '-' ||
       CASE WHEN ln(1 + aov) > threshold THEN 'High' ELSE 'Low' END AS segment,
       t.net AS total_net, t.sales AS total_sales
FROM v_rf r CROSS JOIN v_cut
LEFT JOIN (SELECT "Outlet_ID", sum("Net_Amt") AS net, sum("SalesValue_atBasicRate") AS sales FROM txn GROUP BY 1) t
  USING ("Outlet_ID")
""")


@query("order_level", """
SELECT "Outlet_ID", "Date", "Bill_No", "Final_State", round(q, 4) AS "Quantity", round(net, 4) AS "Net_Amt" FROM v_orders
""")
def _(spark, sf):
    o = R.order_level(txn(spark, sf, *R.ORDER_KEYS, "Quantity", "Net_Amt"))
    return o.select(*R.ORDER_KEYS, F.round("Quantity", 4).alias("Quantity"), F.round("Net_Amt", 4).alias("Net_Amt"))


@query("rfm_outlets", """
SELECT "Outlet_ID", "Final_State", first_order, last_order, unique_order_days, orders_count,
       CAST(round(CAST(aov AS DECIMAL(38,8)), 4) AS DOUBLE) AS "AOV", recency_days AS "Recency_days", r_label AS "R_label", active_days,
       round(orders_per_day, 6) AS orders_per_day, f_label AS "F_label", m_label AS "M_label",
       segment AS "RFM_Segment", round(total_net, 4) AS "Total_Net_Amt"
FROM v_rfm
""")
def _(spark, sf):
    return outlets(spark, sf).select(
        "Outlet_ID", "Final_State", "first_order", "last_order", "unique_order_days", "orders_count",
        K.half_up("AOV", 4).alias("AOV"), F.col("Recency_days").cast("bigint").alias("Recency_days"), "R_label",
        F.col("active_days").cast("bigint").alias("active_days"), F.round("orders_per_day", 6).alias("orders_per_day"),
        "F_label", "M_label", "RFM_Segment", F.round("Total_Net_Amt", 4).alias("Total_Net_Amt"))


@query("segment_summary", """
SELECT s.segment, coalesce(n, 0) AS total_outlets,
       round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM v_rfm), 2) AS percentage,
       coalesce(s1, 0) AS nation_3_count, coalesce(s2, 0) AS nation_17_count,
       round(coalesce(days, 0), 2) AS avg_order_days, round(coalesce(a, 0), 2) AS avg_aov,
       round(coalesce(rec, 0), 2) AS avg_recency,
       round(coalesce(sales, 0) * 100.0 / (SELECT sum("SalesValue_atBasicRate") FROM txn), 2) AS market_share
FROM (SELECT r || '-' || f || '-' || m AS segment FROM (VALUES ('Recent'), ('Stale')) a(r),
      (VALUES ('High'), ('Low')) b(f), (VALUES ('High'), ('Low')) c(m)) s
LEFT JOIN (SELECT segment, count(*) AS n, count(*) FILTER ("Final_State" = 'NATION_3') AS s1,
             count(*) FILTER ("Final_State" = 'NATION_17') AS s2, avg(unique_order_days) AS days, avg(aov) AS a,
             avg(recency_days) AS rec FROM v_rfm GROUP BY 1) g USING (segment)
LEFT JOIN (SELECT segment, sum(total_sales) AS sales
           FROM (SELECT DISTINCT segment, "Outlet_ID", total_sales FROM v_rfm) GROUP BY 1) h USING (segment)
""")
def _(spark, sf):
    return R.segment_summary(outlets(spark, sf), STATES)


@query("cluster_summary", """
SELECT kind, cluster, outlets, round(a, 4) AS min_value, round(b, 4) AS max_value, round(c, 4) AS mean_value FROM (
  SELECT 'frequency' AS kind, f_label AS cluster, count(*) AS outlets, min(orders_per_day) AS a, max(orders_per_day) AS b,
         avg(orders_per_day) AS c FROM v_rfm GROUP BY 2
  UNION ALL SELECT 'monetary', m_label, count(*), min(aov), max(aov), avg(aov) FROM v_rfm GROUP BY 2)
""")
def _(spark, sf):
    return R.cluster_summary(outlets(spark, sf)).select(
        "kind", "cluster", "outlets", *[F.round(c, 4).alias(c) for c in ("min_value", "max_value", "mean_value")])


@query("segment_kpis", """
SELECT count(*) AS total_outlets,
       round(count(*) FILTER (segment LIKE 'Recent-%') * 100.0 / count(*), 4) AS recent_pct,
       round(count(*) FILTER (segment LIKE '%-High-%') * 100.0 / count(*), 4) AS high_frequency_pct,
       round(count(*) FILTER (segment LIKE '%-High') * 100.0 / count(*), 4) AS high_monetary_pct,
       round(avg(aov), 4) AS avg_aov, round(avg(unique_order_days), 4) AS avg_order_days,
       round(avg(orders_per_day), 6) AS avg_orders_per_day
FROM v_rfm
""")
def _(spark, sf):
    k = R.segment_kpis(outlets(spark, sf))
    return k.select("total_outlets", *[F.round(c, 6 if c == "avg_orders_per_day" else 4).alias(c) for c in k.columns[1:]])


@query("monetary_split", """
SELECT "Outlet_ID", CAST(round(CAST(aov AS DECIMAL(38,8)), 4) AS DOUBLE) AS "AOV", m_label AS "M_label", CASE WHEN m_label = 'High' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "M_cluster_id"
FROM v_rfm
""")
def _(spark, sf):
    base = R.recency_frequency(txn(spark, sf, *FACT), PARAMS)
    return R.monetary_split(base).select("Outlet_ID", K.half_up("AOV", 4).alias("AOV"), "M_label", "M_cluster_id")


@query("rfm_segment", """
SELECT segment AS "RFM_Segment", count(*) AS outlets, min("Outlet_ID") AS first_outlet FROM v_rfm GROUP BY 1
""")
def _(spark, sf):
    return outlets(spark, sf).groupBy("RFM_Segment").agg(
        F.count("*").alias("outlets"), F.min("Outlet_ID").alias("first_outlet"))


@query("join_outlet_totals", """
SELECT c."Outlet_ID", c.grp, round(t.net, 4) AS "Total_Net_Amt"
FROM (SELECT CAST(c_custkey AS VARCHAR) AS "Outlet_ID", c_mktsegment AS grp FROM customer) c
LEFT JOIN (SELECT "Outlet_ID", sum("Net_Amt") AS net FROM txn GROUP BY 1) t USING ("Outlet_ID")
""")
def _(spark, sf):
    from tradelift.plans.fixtures import table
    all_outlets = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Outlet_ID"), F.col("c_mktsegment").alias("grp"))
    return R.join_outlet_totals(all_outlets, txn(spark, sf, "Outlet_ID", "Net_Amt"), "left").withColumn(
        "Total_Net_Amt", F.round("Total_Net_Amt", 4))


@query("outlet_search", """
SELECT "Outlet_ID", "Final_State", segment AS "RFM_Segment" FROM v_rfm
WHERE contains(lower("Outlet_ID"), 'ion_1') OR contains(lower("Final_State"), 'ion_1') OR contains(lower(segment), 'ion_1')
""")
def _(spark, sf):
    return R.outlet_search(outlets(spark, sf), " ION_1 ").select("Outlet_ID", "Final_State", "RFM_Segment")


@query("sort_page", """
SELECT "Outlet_ID", "Final_State", round(total_net, 4) AS "Total_Net_Amt", n AS total_rows,
       CAST(ceil(n / 50.0) AS BIGINT) AS total_pages, CAST(3 AS BIGINT) AS page
FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY total_net DESC, "Outlet_ID", "Final_State") AS rn FROM v_rfm)
WHERE rn BETWEEN 101 AND 150
""")
def _(spark, sf):
    p = R.sort_page(outlets(spark, sf), "total_net_amt", True, page=3, page_size=50)
    return p.select("Outlet_ID", "Final_State", F.round("Total_Net_Amt", 4).alias("Total_Net_Amt"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("total_rows", "total_pages", "page")])


@query("numbered_outlets", """
SELECT "Outlet_ID", "Final_State", row_number() OVER (ORDER BY recency_days DESC NULLS LAST, "Outlet_ID", "Final_State") AS place FROM v_rfm
""")
def _(spark, sf):
    order = [("Recency_days", True, True), ("Outlet_ID", False, False), ("Final_State", False, False)]
    return ranking.numbered(outlets(spark, sf), order, "place").select("Outlet_ID", "Final_State", "place")


@query("deep_page", """
SELECT "Outlet_ID", "Final_State", orders_count FROM v_rfm
QUALIFY row_number() OVER (ORDER BY orders_count, "Outlet_ID", "Final_State") BETWEEN count(*) OVER () // 2 + 1 AND count(*) OVER () // 2 + 20
""")
def _(spark, sf):
    # A low bound of rows to sort, so that the tables of every scale are narrowed.
    rows = cut(outlets(spark, sf).select("Outlet_ID", "Final_State", "orders_count"))
    n = rows.count()
    return ranking.page(rows, [("orders_count", False, True), ("Outlet_ID", False, False), ("Final_State", False, False)], n // 2, 20, n, direct=100)


@query("approx_order_days", """
SELECT "Outlet_ID", "Final_State", unique_order_days, TRUE AS within FROM v_rfm
""")
def _(spark, sf):
    keys = ["Outlet_ID", "Final_State"]
    near = R.rfm_outlets(txn(spark, sf, *FACT), replace(PARAMS, sketch_bits=sketches.LG_K)).select(*keys, F.col("unique_order_days").alias("days"))
    return outlets(spark, sf).join(near, keys).select(*keys, "unique_order_days", sketches.within("days", "unique_order_days").alias("within"))


@query("export_outlets", """
SELECT "Outlet_ID", "Final_State" AS "State", segment AS "RFM_Segment", round(total_net, 4) AS "Total_Net_Amt",
       orders_count AS "Orders", CAST(round(CAST(aov AS DECIMAL(38,8)), 4) AS DOUBLE) AS "AOV", recency_days AS "Recency_Days",
       unique_order_days AS "Unique_Order_Days", round(orders_per_day, 6) AS "Orders_Per_Day",
       first_order AS "First_Order", last_order AS "Last_Order" FROM v_rfm
""")
def _(spark, sf):
    return R.export_outlets(outlets(spark, sf)).withColumns({
        "Total_Net_Amt": F.round("Total_Net_Amt", 4), "AOV": K.half_up("AOV", 4),
        "Orders_Per_Day": F.round("Orders_Per_Day", 6), "Recency_Days": F.col("Recency_Days").cast("bigint")})


@query("backfill_fields", """
SELECT "Outlet_ID", "Final_State", active_days, round(orders_per_day, 6) AS orders_per_day,
       CASE WHEN unique_order_days >= 10 THEN 'High' ELSE 'Low' END AS "F_label", m_label AS "M_label", segment AS "RFM_Segment"
FROM v_rfm
""")
def _(spark, sf):
    # An older table: no activity columns and the two monetary labels exchanged.
    old = outlets(spark, sf).drop("active_days", "orders_per_day", "F_label", "F_cluster_id", "RFM_Segment").withColumn(
        "M_label", F.when(F.col("M_label") == "High", "Low").otherwise("High"))
    return R.backfill_fields(old, PARAMS.frequency_threshold).select(
        "Outlet_ID", "Final_State", F.col("active_days").cast("bigint").alias("active_days"),
        F.round("orders_per_day", 6).alias("orders_per_day"), "F_label", "M_label", "RFM_Segment")
