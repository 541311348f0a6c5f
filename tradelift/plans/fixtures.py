"""Maps the driver's star schema to the fact table, reading only what a query asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelift.plans.registry import view

_C, _E = F.col, F.expr

# column -> (expression, tables needed beside lineitem)
_COLUMNS = {
    "Date": ("CAST(o_orderdate AS DATE)", "o"),
    "Outlet_ID": ("CAST(o_custkey AS STRING)", "o"),
    "Bill_No": ("CAST(l_orderkey AS STRING)", ""),
    "Final_State": ("n_name", "ocn"),
    "Final_Outlet_Classification": (
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'WH' WHEN 'MACHINERY' THEN 'SS' ELSE 'OTHERGT' END", "oc"),
    "Outlet_Type": ("CASE WHEN o_orderpriority = '5-LOW' THEN 'MT' ELSE 'GT' END", "o"),
    "Category": ("p_type", "p"),
    "Subcategory": ("upper(p_name)", "p"),
    "Brand": ("upper(p_brand)", "p"),
    "Sizes": ("CASE WHEN p_size <= 25 THEN '12-ML' ELSE '18-ML' END", "p"),
    "Slab": (
        "CASE WHEN l_quantity < 8 THEN 'slab0' WHEN l_quantity < 20 THEN 'slab1' "
        "WHEN l_quantity < 36 THEN 'slab2' ELSE 'slab3' END", ""),
    "Quantity": ("CAST(l_quantity AS DOUBLE)", ""),
    "MRP": ("p_retailprice", "p"),
    "SalesValue_atBasicRate": ("l_extendedprice", ""),
    "TotalDiscount": ("l_extendedprice * l_discount", ""),
    "Net_Amt": ("l_extendedprice - l_extendedprice * l_discount", ""),
    "Scheme_Discount": ("l_extendedprice * l_discount", ""),
    "Staggered_qps": ("l_extendedprice * l_tax", ""),
    "Basic_Rate_Per_PC_without_GST": ("l_extendedprice / l_quantity", ""),
    "Selling_Rate_Per_PC_without_GST_CLP": ("l_extendedprice / l_quantity * (1 - l_discount)", ""),
    "Sku_Code": ("CAST(l_partkey AS STRING)", ""),
    "Sku_Name": ("p_name", "p"),
    "Store_ID": ("CAST(o_custkey AS STRING)", "o"),
    "Distributor_ID": ("CAST(l_suppkey AS STRING)", ""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Fact rows with the named columns. Every foreign key of the driver data resolves, so a
    dimension nobody asks for is not joined; Spark sizes each join side itself."""
    columns = columns or tuple(c for c in _COLUMNS if c not in ("Store_ID", "Distributor_ID"))
    needed = set("".join(_COLUMNS[c][1] for c in columns))
    df = table(spark, sf_dir, "lineitem")
    if "o" in needed:
        df = df.join(table(spark, sf_dir, "orders"), _C("l_orderkey") == _C("o_orderkey"))
    if "c" in needed:
        df = df.join(table(spark, sf_dir, "customer"), _C("o_custkey") == _C("c_custkey"))
    if "n" in needed:
        df = df.join(table(spark, sf_dir, "nation"), _C("c_nationkey") == _C("n_nationkey"))
    if "p" in needed:
        df = df.join(table(spark, sf_dir, "part"), _C("l_partkey") == _C("p_partkey"))
    return df.select(*[_E(_COLUMNS[c][0]).alias(c) for c in columns])


view("txn", """
SELECT CAST(o.o_orderdate AS DATE) AS "Date",
       CAST(c.c_custkey AS VARCHAR) AS "Outlet_ID",
       CAST(o.o_orderkey AS VARCHAR) AS "Bill_No",
       n.n_name AS "Final_State",
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'WH' WHEN 'MACHINERY' THEN 'SS' ELSE 'OTHERGT' END
         AS "Final_Outlet_Classification",
       CASE WHEN o.o_orderpriority = '5-LOW' THEN 'MT' ELSE 'GT' END AS "Outlet_Type",
       p.p_type AS "Category", upper(p.p_name) AS "Subcategory", upper(p.p_brand) AS "Brand",
       CASE WHEN p.p_size <= 25 THEN '12-ML' ELSE '18-ML' END AS "Sizes",
       CASE WHEN l.l_quantity < 8 THEN 'slab0' WHEN l.l_quantity < 20 THEN 'slab1'
            WHEN l.l_quantity < 36 THEN 'slab2' ELSE 'slab3' END AS "Slab",
       CAST(l.l_quantity AS DOUBLE) AS "Quantity",
       p.p_retailprice AS "MRP",
       l.l_extendedprice AS "SalesValue_atBasicRate",
       l.l_extendedprice * l.l_discount AS "TotalDiscount",
       l.l_extendedprice - l.l_extendedprice * l.l_discount AS "Net_Amt",
       l.l_extendedprice * l.l_discount AS "Scheme_Discount",
       l.l_extendedprice * l.l_tax AS "Staggered_qps",
       l.l_extendedprice / l.l_quantity AS "DSP",
       l.l_extendedprice / l.l_quantity * (1 - l.l_discount) AS "CLP",
       CAST(p.p_partkey AS VARCHAR) AS "Sku_Code", p.p_name AS "Sku_Name",
       CAST(l.l_suppkey AS VARCHAR) AS "Distributor_ID",
       CAST(date_trunc('month', o.o_orderdate) AS DATE) AS "Month"
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
""")
