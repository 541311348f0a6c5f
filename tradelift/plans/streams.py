"""Incremental ingest queries: the stream's result must equal the batch result."""

from pyspark.sql import functions as F

from tradelift.plans.fixtures import txn
from tradelift.functions.lineage import work_dir
from tradelift.plans.registry import query
from tradelift.sources import sinks
from tradelift.streaming import drops as T, table as MT

COLUMNS = ("Date", "Outlet_ID", "Bill_No", "Sizes", "Slab", "Quantity", "SalesValue_atBasicRate", "TotalDiscount", "Net_Amt")


def write_drops(spark, sf):
    """Three drops; the middle of the time range arrives last."""
    folder = work_dir(spark, "stream")
    t = txn(spark, sf, *COLUMNS)
    year = F.year("Date")
    for i, part in enumerate((t.where(year < 1997), t.where(year >= 1999), t.where((year >= 1997) & (year < 1999)))):
        part.write.parquet(f"{folder}/in/drop_{i}.parquet")
    return folder


@query("incremental_drop_ingest", """
SELECT "Sizes", "Outlet_ID", "Month" AS period, round(sum("Quantity"), 4) AS quantity, round(sum("Net_Amt"), 4) AS net_amt, count(*) AS rows FROM txn GROUP BY ALL
""")
def _(spark, sf):
    folder = write_drops(spark, sf)
    T.ingest_month_sums(T.drop_stream(spark, f"{folder}/in", 8), f"{folder}/out", f"{folder}/ckpt")
    m = T.month_sums(spark, f"{folder}/out")
    return m.select("Sizes", "Outlet_ID", "period", F.round("quantity", 4).alias("quantity"), F.round("net_amt", 4).alias("net_amt"), "rows")


@query("windowed_drop_ingest", """
SELECT "Date", "Sizes", "Slab", round(sum("Quantity"), 4) AS quantity, count(*) AS rows FROM txn GROUP BY ALL
""")
def _(spark, sf):
    folder = write_drops(spark, sf)
    days = T.watermarked_days(T.drop_stream(spark, f"{folder}/in", 8), lateness="4000 days")
    T.ingest_days(days, f"{folder}/out", f"{folder}/ckpt")
    return T.latest_days(spark, f"{folder}/out").select("Date", "Sizes", "Slab", F.round("quantity", 4).alias("quantity"), "rows")


@query("month_table", """
SELECT 'all' AS part, "Sizes", "Outlet_ID", "Month" AS period, round(sum("Quantity"), 4) AS quantity, round(sum("Net_Amt"), 4) AS net_amt, count(*) AS rows FROM txn GROUP BY ALL
UNION ALL SELECT 'late', "Sizes", "Outlet_ID", "Month", round(sum("Quantity"), 4), round(sum("Net_Amt"), 4), count(*) FROM txn WHERE year("Date") IN (1997, 1998) GROUP BY ALL
UNION ALL SELECT 'changed', "Sizes", "Outlet_ID", "Month", round(sum("Quantity"), 4), round(sum("Net_Amt"), 4), count(*) FROM txn WHERE year("Date") >= 1999 GROUP BY ALL
""")
def _(spark, sf):
    """Three drops, taken in as they come: the last is late, and the third batch merges all folders."""
    folder = work_dir(spark, "table")
    t, year = txn(spark, sf, *COLUMNS), F.year("Date")
    table = MT.MonthTable(spark, f"{folder}/table", fan_in=2)
    for i, part in enumerate((t.where(year < 1997), t.where(year >= 1999), t.where((year >= 1997) & (year < 1999)))):
        part.write.parquet(f"{folder}/in/drop_{i}.parquet")
        MT.ingest(T.drop_stream(spark, f"{folder}/in", 100_000), table, f"{folder}/ckpt")
    parts = [table.read(), table.late_rows(), table.changes(2)]
    named = [d.select(F.lit(n).alias("part"), "Sizes", "Outlet_ID", "period", F.round("quantity", 4).alias("quantity"), F.round("net_amt", 4).alias("net_amt"), "rows")
             for n, d in zip(("all", "late", "changed"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])
