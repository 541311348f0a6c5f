"""Source, scope and set queries."""

from pyspark.sql import functions as F

from tradelift.functions import columns as K
from tradelift.operators import scope as S, store as ST
from tradelift.plans import registry, rfm as PR
from tradelift.plans.fixtures import table, txn
from tradelift.functions.lineage import work_dir
from tradelift.plans.registry import query, view
from tradelift.schema import Filters, SlabRules
from tradelift.sources import ingest as I, sinks

RULES = SlabRules("define", per_size={"12-ML": (32.0, 80.0), "18-ML": (24.0, 48.0, 80.0, 120.0)})

view("v_defined", """
SELECT t.* EXCLUDE ("Slab"), CASE
  WHEN "Sizes" = '12-ML' THEN CASE WHEN mq < 32 THEN 'slab0' WHEN mq < 80 THEN 'slab1' ELSE 'slab2' END
  WHEN mq < 24 THEN 'slab0' WHEN mq < 48 THEN 'slab1' WHEN mq < 80 THEN 'slab2' WHEN mq < 120 THEN 'slab3' ELSE 'slab4' END AS "Slab", mq
FROM (SELECT *, sum("Quantity") OVER (PARTITION BY "Outlet_ID", "Month", "Sizes") AS mq FROM txn) t
""")


def drifted(spark, sf):
    """Fact rows under the spellings, paddings and texts monthly drops come with."""
    t = txn(spark, sf, "Date", "Outlet_ID", "Bill_No", "Final_State", "Category", "Subcategory", "Brand", "Sizes",
            "Quantity", "MRP", "SalesValue_atBasicRate", "TotalDiscount")
    return t.select(
        "Date", "Outlet_ID", F.col("Bill_No").alias("invoice_no"), F.col("Final_State").alias("final_state"),
        F.concat(F.lit("  "), F.lower("Category")).alias("category"),
        F.regexp_replace(F.lower("Subcategory"), " ", "   ").alias("subcategory"), F.lower("Brand").alias("brand"),
        F.when(F.col("Sizes") == "12-ML", "12 ml").otherwise("18").alias("sizes"),
        F.when(F.col("Quantity") == 13, "n/a").otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
        F.col("MRP").alias("mrp"), "SalesValue_atBasicRate", "TotalDiscount")


@query("scan_transactions", """
SELECT "Month", "Sizes", count(*) AS rows_read, count(DISTINCT "Bill_No") AS bills,
       round(sum(CASE WHEN "Date" >= DATE '1998-07-01' OR "Quantity" <> 13 THEN "Quantity" END), 2) AS quantity, round(sum("Net_Amt"), 4) AS net
FROM txn GROUP BY ALL
""")
def _(spark, sf):
    folder = work_dir(spark, "drops")
    cut = F.lit("1998-07-01").cast("date")
    drifted(spark, sf).where(F.col("Date") < cut).write.parquet(f"{folder}/drop_1.parquet")
    txn(spark, sf).where(F.col("Date") >= cut).write.parquet(f"{folder}/drop_2.parquet")
    got = I.scan_transactions(spark, folder, required=("Date", "Outlet_ID", "Quantity"))
    return got.groupBy(K.month_of("Date").alias("Month"), "Sizes").agg(
        F.count("*").alias("rows_read"), F.count_distinct("Bill_No").alias("bills"),
        F.round(F.sum("Quantity"), 2).alias("quantity"), F.round(F.sum("Net_Amt"), 4).alias("net"))


@query("unify_aliases", """
SELECT "Sizes", "Final_State", count(DISTINCT "Bill_No") AS bills, round(sum("MRP"), 2) AS mrp FROM txn GROUP BY ALL
""")
def _(spark, sf):
    return I.unify_aliases(drifted(spark, sf)).groupBy(I.norm_size("Sizes").alias("Sizes"), "Final_State").agg(
        F.count_distinct("Invoice_No").alias("bills"), F.round(F.sum("MRP"), 2).alias("mrp"))


@query("stable_schema", """
SELECT "Outlet_ID", count("Bill_No") AS bills, count(NULL) AS slabs, round(sum("Net_Amt"), 4) AS net FROM txn GROUP BY 1
""")
def _(spark, sf):
    return I.stable_schema(I.unify_aliases(drifted(spark, sf))).groupBy("Outlet_ID").agg(
        F.count("Bill_No").alias("bills"), F.count("Slab").alias("slabs"), F.round(F.sum("Net_Amt"), 4).alias("net"))


@query("coerce_numeric", """
SELECT "Month", count(*) AS rows_read, count(CASE WHEN "Quantity" <> 13 THEN 1 END) AS numbers,
       sum(CASE WHEN "Quantity" <> 13 THEN "Quantity" END) AS quantity FROM txn GROUP BY 1
""")
def _(spark, sf):
    return I.coerce_numeric(drifted(spark, sf)).groupBy(K.month_of("Date").alias("Month")).agg(
        F.count("*").alias("rows_read"), F.count("Quantity").alias("numbers"), F.sum("Quantity").alias("quantity"))


@query("normalize_text_dims", """
SELECT "Category", "Subcategory", "Brand", count(*) AS n FROM txn GROUP BY ALL
""")
def _(spark, sf):
    return I.normalize_text_dims(I.unify_aliases(drifted(spark, sf))).groupBy("Category", "Subcategory", "Brand").agg(
        F.count("*").alias("n"))


@query("normalize_size", """SELECT "Sizes", count(*) AS n, round(sum("MRP"), 2) AS mrp FROM txn GROUP BY 1""")
def _(spark, sf):
    return I.normalize_size(I.unify_aliases(drifted(spark, sf))).groupBy("Sizes").agg(
        F.count("*").alias("n"), F.round(F.sum("MRP"), 2).alias("mrp"))


@query("canonical_state", """
SELECT CASE WHEN contains(raw, 'U.P') OR contains(raw, 'UP') THEN 'UP' WHEN raw IN ('MH') OR contains(raw, 'MUMBAI') THEN 'MAH' ELSE raw END AS state,
       count(*) AS n FROM (SELECT CASE CAST(regexp_extract("Final_State", '[0-9]+') AS INT) % 4 WHEN 0 THEN 'MH' WHEN 1 THEN 'NAVI MUMBAI'
       WHEN 2 THEN 'U.P. EAST' ELSE "Final_State" END AS raw FROM txn) GROUP BY 1
""")
def _(spark, sf):
    n = F.regexp_extract("Final_State", r"(\d+)", 1).cast("int") % 4
    raw = F.when(n == 0, " mh ").when(n == 1, "Navi  Mumbai").when(n == 2, "u.p. east").otherwise(F.col("Final_State"))
    return txn(spark, sf, "Final_State").select(I.canonical_state(raw).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("project_scope", """
SELECT "Subcategory", "Sizes", count(*) AS n FROM txn WHERE "Subcategory" IN ('RED WIDGET', 'BLUE BOLT') AND "Sizes" = '12-ML' GROUP BY ALL
""")
def _(spark, sf):
    d = I.project_scope(I.unify_aliases(drifted(spark, sf)), ("RED WIDGET", "BLUE BOLT"), ("12-ML",))
    return d.groupBy(K.norm_text("Subcategory").alias("Subcategory"), K.norm_size("Sizes").alias("Sizes")).agg(F.count("*").alias("n"))


@query("invoice_key", """
SELECT "Outlet_ID" || '|' || "Bill_No" || '|' || strftime("Date", '%Y-%m-%d') AS invoice, count(*) AS lines FROM txn GROUP BY 1
""")
def _(spark, sf):
    return txn(spark, sf, "Outlet_ID", "Bill_No", "Date").groupBy(I.invoice_key().alias("invoice")).agg(F.count("*").alias("lines"))


@query("store_key", """
SELECT "Distributor_ID" || ' ' || "Outlet_ID" AS "Store_Key", count(*) AS lines FROM txn GROUP BY 1
""")
def _(spark, sf):
    t = txn(spark, sf, "Distributor_ID", "Outlet_ID").withColumn("Store_ID", F.lit("  "))
    return I.store_key(t).groupBy("Store_Key").agg(F.count("*").alias("lines"))


@query("require_columns", """
SELECT 'lineitem' AS table_name, 'Missing required columns: Slab' AS message, count(*) AS rows_seen FROM lineitem
""")
def _(spark, sf):
    t = table(spark, sf, "lineitem")
    missing = I.require_columns(t, ["l_orderkey", "l_quantity", "Slab"], raise_error=False)
    return t.agg(F.count("*").alias("rows_seen")).select(
        F.lit("lineitem").alias("table_name"), F.lit(f"Missing required columns: {', '.join(missing)}").alias("message"), "rows_seen")


@query("write_result_tables", """
SELECT "Sizes" AS size, "Month" AS month, round(sum("Quantity"), 2) AS volume, round(sum("SalesValue_atBasicRate"), 2) AS sales FROM txn GROUP BY ALL
""")
def _(spark, sf):
    folder = work_dir(spark, "tables")
    t = txn(spark, sf, "Date", "Sizes", "Quantity", "SalesValue_atBasicRate").groupBy(
        F.col("Sizes").alias("size"), K.month_of("Date").alias("month")).agg(
        F.round(F.sum("Quantity"), 2).alias("volume"), F.round(F.sum("SalesValue_atBasicRate"), 2).alias("sales"))
    path, = sinks.write_result_tables({"pack_month": t}, folder, "csv", partition_by=("size",))
    return spark.read.schema("month date, volume double, sales double, size string").csv(path, header=True).select("size", "month", "volume", "sales")


@query("reconcile_sources", """
SELECT strftime(m, '%Y-%m') AS month, size, round(a, 2) AS left_value, round(b, 2) AS right_value,
       round(coalesce(b, 0) - coalesce(a, 0), 2) AS diff_value,
       CASE WHEN a IS NOT NULL AND b IS NOT NULL AND abs(coalesce(b, 0) - coalesce(a, 0)) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT "Month" AS m, "Sizes" AS size, sum("Quantity") AS a FROM txn WHERE "Outlet_Type" = 'GT' GROUP BY ALL)
FULL JOIN (SELECT "Month" AS m, "Sizes" AS size, sum("Quantity") AS b FROM txn WHERE "Outlet_Type" = 'GT' AND "Quantity" > 1 AND "Date" >= DATE '1996-01-01' GROUP BY ALL)
USING (m, size)
""")
def _(spark, sf):
    t = txn(spark, sf, "Date", "Sizes", "Outlet_Type", "Quantity").where("Outlet_Type = 'GT'")
    later = t.where("Quantity > 1 AND Date >= DATE '1996-01-01'")
    r = I.reconcile_sources(t, later, "Quantity", tolerance=0.5)
    return r.select("month", "size", "status", *[F.round(c, 2).alias(c) for c in ("left_value", "right_value", "diff_value")])


@query("full_outer_diff", """
SELECT month, size, round(a, 2) AS left_value, round(b, 2) AS right_value, round(coalesce(b, 0) - coalesce(a, 0), 2) AS diff_value,
       CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a = b THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT "Final_State" AS month, "Sizes" AS size, sum("Quantity") AS a FROM txn WHERE "Slab" = 'slab1' GROUP BY ALL)
FULL JOIN (SELECT "Final_State" AS month, "Sizes" AS size, sum("Quantity") AS b FROM txn WHERE "Slab" = 'slab2' GROUP BY ALL) USING (month, size)
""")
def _(spark, sf):
    t = txn(spark, sf, "Final_State", "Sizes", "Slab", "Quantity")

    def part(slab, name):
        return t.where(F.col("Slab") == slab).groupBy(F.col("Final_State").alias("month"), F.col("Sizes").alias("size")).agg(F.sum("Quantity").alias(name))

    r = I.full_outer_diff(part("slab1", "left_value"), part("slab2", "right_value"))
    return r.select("month", "size", "status", *[F.round(c, 2).alias(c) for c in ("left_value", "right_value", "diff_value")])


@query("read_plan_grid", """
SELECT scenario, month_no, CAST((month_no + 8) % 12 AS INTEGER) AS plan_idx, round(pct, 2) AS pct FROM (
  SELECT "Final_Outlet_Classification" AS scenario, CAST(month("Date") AS INTEGER) AS month_no,
         CAST(round(CAST(sum("TotalDiscount") / sum("SalesValue_atBasicRate") * 100 AS DECIMAL(38,8)), 2) AS DOUBLE) AS pct FROM txn GROUP BY ALL)
""")
def _(spark, sf):
    sheet = txn(spark, sf, "Date", "Final_Outlet_Classification", "TotalDiscount", "SalesValue_atBasicRate").groupBy(
        F.date_format("Date", "MMMM").alias("Month")).pivot("Final_Outlet_Classification", ["OTHERGT", "SS", "WH"]).agg(
        F.concat(K.half_up(F.sum("TotalDiscount") / F.sum("SalesValue_atBasicRate") * 100, 2).cast("string"), F.lit("%")))
    return I.read_plan_grid(sheet)


@query("saved_reports", """
SELECT md5("Final_State" || 'step4') AS report_key, 'step4' AS step, 'Plan ' || "Final_State" AS report_name, max("Date") AS created_at,
       CAST(count(DISTINCT "Outlet_ID") AS VARCHAR) AS outlets
FROM txn GROUP BY "Final_State" ORDER BY created_at DESC, report_key DESC LIMIT 10
""")
def _(spark, sf):
    folder = work_dir(spark, "reports")
    t = txn(spark, sf, "Final_State", "Outlet_ID", "Date", "Sizes", "Quantity")
    key = F.md5(F.concat("Final_State", F.lit("step4")))
    head = t.groupBy("Final_State").agg(F.count_distinct("Outlet_ID").alias("o"), F.max("Date").alias("created_at")).select(
        key.alias("report_key"), F.lit(" STEP4").alias("step"), F.concat(F.lit("Plan "), "Final_State").alias("report_name"),
        F.lit("ly_same_3m").alias("reference_mode"), F.create_map(F.lit("outlets"), F.col("o").cast("string")).alias("metadata"), "created_at")
    rows = t.groupBy(key.alias("report_key"), F.col("Sizes").alias("item")).agg(F.sum("Quantity").alias("value"))
    sinks.save_reports(head, rows, folder)
    return sinks.list_reports(spark, folder, 10).select("report_key", "step", "report_name", "created_at", F.col("metadata")["outlets"].alias("outlets"))


F1 = Filters(states=("NATION_3", "NATION_4", "NATION_7"), categories=("PROMO", "LARGE"), sizes=("12-ML",), outlet_classifications=("wh",))


@query("base_filters", """
SELECT "Final_State", "Category", count(*) AS n, sum("Quantity") AS quantity FROM txn
WHERE "Final_State" IN ('NATION_3', 'NATION_4', 'NATION_7') AND "Category" IN ('PROMO', 'LARGE') AND "Sizes" = '12-ML'
  AND "Final_Outlet_Classification" = 'WH' GROUP BY ALL
""")
def _(spark, sf):
    t = txn(spark, sf, "Final_State", "Category", "Sizes", "Final_Outlet_Classification", "Quantity")
    return S.base_filters(t, F1).groupBy("Final_State", "Category").agg(F.count("*").alias("n"), F.sum("Quantity").alias("quantity"))


@query("outlet_group", """
SELECT CASE "Final_Outlet_Classification" WHEN 'WH' THEN 'WH' ELSE 'OtherGT' END AS "Outlet_Group",
       count(DISTINCT "Outlet_ID") AS outlets, count(*) AS n FROM txn GROUP BY 1
""")
def _(spark, sf):
    return S.with_outlet_group(txn(spark, sf, "Final_Outlet_Classification", "Outlet_ID")).groupBy("Outlet_Group").agg(
        F.count_distinct("Outlet_ID").alias("outlets"), F.count("*").alias("n"))


view("v_step", """
SELECT * FROM v_defined WHERE "Outlet_ID" IN (SELECT "Outlet_ID" FROM v_rfm WHERE segment IN ('Recent-High-High', 'Recent-Low-High', 'Stale-High-Low'))
  AND "Outlet_ID" IN (SELECT "Outlet_ID" FROM txn WHERE "Final_Outlet_Classification" <> 'WH')
""")
SEGS = ("Recent-High-High", "Recent-Low-High", "Stale-High-Low")


@query("step_scope", """
SELECT 'scope' AS part, "Sizes", "Slab", count(*) AS n, sum("Quantity") AS quantity FROM v_step WHERE "Slab" IN ('slab1', 'slab3') GROUP BY ALL
UNION ALL SELECT 'all_slabs', "Sizes", "Slab", count(*), sum("Quantity") FROM v_step GROUP BY ALL
""")
def _(spark, sf):
    fact = txn(spark, sf, *PR.FACT, "Sizes", "Quantity", "Final_Outlet_Classification")
    scope, every = S.step_scope(fact, PR.outlets(spark, sf), SEGS, ("SS",), (), ("slab1", "slab3"), RULES)

    def count(df, name):
        return df.groupBy("Sizes", "Slab").agg(F.count("*").alias("n"), F.sum("Quantity").alias("quantity")).select(
            F.lit(name).alias("part"), "Sizes", "Slab", "n", "quantity")

    return count(scope, "scope").unionByName(count(every, "all_slabs"))


@query("allowed_slab", """
SELECT "Slab", count(*) AS n, bool_and("Slab" <> 'slab0') AS allowed, bool_and(true) AS allowed_with_zero FROM txn GROUP BY 1
""")
def _(spark, sf):
    return txn(spark, sf, "Slab").groupBy("Slab").agg(
        F.count("*").alias("n"), F.bool_and(K.allowed_slab("Slab")).alias("allowed"),
        F.bool_and(K.allowed_slab("Slab", include_zero=True)).alias("allowed_with_zero"))


@query("eda_scope", """
SELECT "Sku_Code", count(*) AS n, sum("Quantity") AS quantity FROM txn
WHERE "Brand" IN ('BRAND#2', 'BRAND#17') AND "Final_Outlet_Classification" <> 'WH' AND "Sku_Code" IN ('0', '1', '2', '63', '17') GROUP BY 1
""")
def _(spark, sf):
    t = txn(spark, sf, "Brand", "Final_Outlet_Classification", "Sku_Code", "Quantity")
    f = Filters(brands=("BRAND#2", "BRAND#17"), outlet_classifications=("OtherGT",))
    return S.eda_scope(t, f, ("0", "1", "2", "63", "17")).groupBy("Sku_Code").agg(F.count("*").alias("n"), F.sum("Quantity").alias("quantity"))


_OPTIONS = """
SELECT 'states' AS option, "Final_State" AS value FROM txn UNION SELECT 'categories', "Category" FROM txn {0}
UNION SELECT 'subcategories', "Subcategory" FROM txn {1} UNION SELECT 'brands', "Brand" FROM txn {2}
UNION SELECT 'sizes', "Sizes" FROM txn {3}
UNION SELECT 'outlet_classifications', CASE "Final_Outlet_Classification" WHEN 'WH' THEN 'WH' ELSE 'OtherGT' END FROM txn {4}
"""
DIMS = ("Final_State", "Category", "Subcategory", "Brand", "Sizes", "Final_Outlet_Classification")


@query("filter_options", _OPTIONS.format("", "", "", "", ""))
def _(spark, sf):
    return S.filter_options(txn(spark, sf, *DIMS))


_W1 = "WHERE \"Final_State\" IN ('NATION_3')"
_W2 = _W1 + " AND \"Category\" IN ('PROMO')"
_W3 = _W2 + " AND \"Brand\" IN ('BRAND#2')"


@query("cascading_options", _OPTIONS.format(_W1, _W2, _W2, _W3, _W3))
def _(spark, sf):
    return S.cascading_options(txn(spark, sf, *DIMS), Filters(states=("NATION_3",), categories=("PROMO",), brands=("BRAND#2",)))


@query("discount_options", """
WITH seg AS (SELECT * FROM v_defined WHERE "Outlet_ID" IN (SELECT "Outlet_ID" FROM v_rfm WHERE segment IN ('Recent-High-High', 'Recent-Low-High', 'Stale-High-Low')))
SELECT 'rfm_segments' AS option, segment AS value FROM v_rfm
UNION SELECT 'outlet_classifications', CASE "Final_Outlet_Classification" WHEN 'WH' THEN 'WH' ELSE 'OtherGT' END FROM seg
UNION SELECT 'slabs', "Slab" FROM seg WHERE "Final_Outlet_Classification" <> 'WH' AND "Slab" <> 'slab0'
UNION SELECT 'matching_outlets', CAST(count(DISTINCT "Outlet_ID") AS VARCHAR) FROM v_step WHERE "Slab" IN ('slab1', 'slab3')
""")
def _(spark, sf):
    fact = txn(spark, sf, *PR.FACT, "Sizes", "Quantity", "Final_Outlet_Classification")
    return S.discount_options(fact, PR.outlets(spark, sf), SEGS, ("SS",), ("slab1", "slab3"), RULES)


@query("valid_rows", """
SELECT "Final_State", count(*) AS n FROM txn WHERE "Outlet_Type" = 'GT' AND "Quantity" > 0 AND "Final_State" IN ('NATION_1', 'NATION_2') GROUP BY 1
""")
def _(spark, sf):
    t = txn(spark, sf, "Date", "Quantity", "SalesValue_atBasicRate", "Outlet_Type", "Final_State")
    return S.valid_rows(t, "SalesValue_atBasicRate", "gt", ("nation_1", "NATION_2")).groupBy("Final_State").agg(F.count("*").alias("n"))


@query("fiscal_period", """
SELECT fy, label, count(*) AS n FROM (
  SELECT CAST(year("Date") + CASE WHEN month("Date") >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fy,
         'FY' || right(CAST(year("Date") + CASE WHEN month("Date") >= 4 THEN 1 ELSE 0 END AS VARCHAR), 2) AS label FROM txn) GROUP BY ALL
""")
def _(spark, sf):
    return txn(spark, sf, "Date").groupBy(K.fiscal_year("Date").alias("fy"), K.fiscal_label("Date").alias("label")).agg(F.count("*").alias("n"))


@query("drop_slab0", """SELECT "Slab", count(*) AS n FROM txn WHERE "Slab" <> 'slab0' GROUP BY 1""")
def _(spark, sf):
    return S.drop_slab0(txn(spark, sf, "Slab")).groupBy("Slab").agg(F.count("*").alias("n"))


@query("semi_outlets", """
SELECT "Final_State", count(*) AS n, sum("Quantity") AS quantity FROM txn
WHERE "Outlet_ID" IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000) GROUP BY 1
""")
def _(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("Outlet_ID"))
    return S.semi_outlets(txn(spark, sf, "Outlet_ID", "Final_State", "Quantity"), rich).groupBy("Final_State").agg(
        F.count("*").alias("n"), F.sum("Quantity").alias("quantity"))


@query("outlet_intersection", """
SELECT "Outlet_ID" FROM txn WHERE "Slab" = 'slab3' AND "Category" = 'PROMO' INTERSECT SELECT "Outlet_ID" FROM txn WHERE "Slab" = 'slab0'
""")
def _(spark, sf):
    t = txn(spark, sf, "Outlet_ID", "Slab", "Category")
    return S.outlet_intersection(t.where("Slab = 'slab3' AND Category = 'PROMO'"), t.where("Slab = 'slab0'"))


@query("distinct_rows", """
SELECT "Outlet_ID", "Sizes", max("Date") AS "Date" FROM txn GROUP BY ALL
""")
def _(spark, sf):
    return S.distinct_rows(txn(spark, sf, "Outlet_ID", "Sizes", "Date"), ["Outlet_ID", "Sizes"], last_by="Date")


@query("union_drops", """SELECT "Sizes", count(*) AS n, count("Slab") AS slabs FROM (
  SELECT "Sizes", "Slab" FROM txn WHERE "Outlet_Type" = 'GT' UNION ALL SELECT "Sizes", NULL FROM txn WHERE "Outlet_Type" = 'MT') GROUP BY 1""")
def _(spark, sf):
    t = txn(spark, sf, "Sizes", "Slab", "Outlet_Type")
    return I.union_drops(t.where("Outlet_Type = 'GT'"), t.where("Outlet_Type = 'MT'").drop("Slab")).groupBy("Sizes").agg(
        F.count("*").alias("n"), F.count("Slab").alias("slabs"))


@query("grain_back_join", """
SELECT "Outlet_ID", "Month", "Sizes", count(*) AS lines, min(mq) AS month_quantity FROM v_defined GROUP BY ALL
""")
def _(spark, sf):
    return S.grain_back_join(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity")).groupBy("Outlet_ID", "Month", "Sizes").agg(
        F.count("*").alias("lines"), F.min("Monthly_Quantity").alias("month_quantity"))


@query("assign_slabs", """
SELECT "Sizes", "Slab", count(*) AS lines, count(DISTINCT "Outlet_ID") AS outlets, sum("Quantity") AS quantity FROM v_defined GROUP BY ALL
""")
def _(spark, sf):
    return S.assign_slabs(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity"), RULES).groupBy("Sizes", "Slab").agg(
        F.count("*").alias("lines"), F.count_distinct("Outlet_ID").alias("outlets"), F.sum("Quantity").alias("quantity"))


@query("slab_order", """
SELECT "Slab", CAST(row_number() OVER (ORDER BY CAST(regexp_extract("Slab", '[0-9]+') AS INT), "Slab") AS INTEGER) AS position, n
FROM (SELECT "Slab", count(*) AS n FROM v_defined GROUP BY 1)
""")
def _(spark, sf):
    from tradelift.operators.frame import slab_order
    t = S.assign_slabs(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity"), RULES)
    return slab_order(t.groupBy("Slab").agg(F.count("*").alias("n"))).withColumn("position", F.col("position").cast("int"))


def stored(spark, sf, *columns):
    """The fact as an outlet store. The bound on an outlet's rows is low, so that large outlets of the driver data lie apart."""
    folder = work_dir(spark, "store")
    ST.write_store(txn(spark, sf, *columns), folder, hot_rows=120)
    return ST.open_store(spark, folder)


@query("stored_grain_back_join", registry.ORACLES["grain_back_join"])
def _(spark, sf):
    return ST.grain_back_join(stored(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity")).groupBy("Outlet_ID", "Month", "Sizes").agg(
        F.count("*").alias("lines"), F.min("Monthly_Quantity").alias("month_quantity"))


@query("stored_assign_slabs", registry.ORACLES["assign_slabs"])
def _(spark, sf):
    return ST.assign_slabs(stored(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity"), RULES).groupBy("Sizes", "Slab").agg(
        F.count("*").alias("lines"), F.count_distinct("Outlet_ID").alias("outlets"), F.sum("Quantity").alias("quantity"))


@query("stored_step_scope", registry.ORACLES["step_scope"])
def _(spark, sf):
    store = stored(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity", "Final_Outlet_Classification")
    scope, every = ST.step_scope(store, PR.outlets(spark, sf), SEGS, ("SS",), (), ("slab1", "slab3"), RULES)
    parts = scope.select(F.lit("scope").alias("part"), "Sizes", "Slab", "Quantity").unionByName(every.select(F.lit("all_slabs").alias("part"), "Sizes", "Slab", "Quantity"))
    return parts.groupBy("part", "Sizes", "Slab").agg(F.count("*").alias("n"), F.sum("Quantity").alias("quantity"))


@query("outlet_profile", """
SELECT "Outlet_ID", string_agg(DISTINCT CASE "Final_Outlet_Classification" WHEN 'WH' THEN 'WH' ELSE 'OtherGT' END, ',') AS groups,
  string_agg(DISTINCT "Slab", ',' ORDER BY "Slab") AS slabs,
  coalesce(string_agg(DISTINCT CASE WHEN "Final_Outlet_Classification" = 'WH' THEN "Slab" END, ',' ORDER BY CASE WHEN "Final_Outlet_Classification" = 'WH' THEN "Slab" END), '') AS chosen_slabs
FROM v_defined GROUP BY 1
""")
def _(spark, sf):
    p = S.outlet_profile(txn(spark, sf, "Outlet_ID", "Date", "Sizes", "Quantity", "Final_Outlet_Classification"), RULES, ("WH",))
    return p.select("Outlet_ID", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("groups", "slabs", "chosen_slabs")])
