"""The fact stored by outlet, so that rows meet their outlet's totals without a shuffle.

Rows of ordinary outlets lie in a table bucketed by outlet: their month quantity is a window that reads the table once
and moves nothing. Rows of outlets too large for one task, and rows without an outlet, lie in a second table as they
came; their totals are combined where the rows are and joined back."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradelift.functions.columns import allowed_slab, month_of, outlet_group
from tradelift.operators import scope as S
from tradelift.schema import SlabRules

BROADCAST_ROWS = 200_000
MAX_BUCKETS = 100_000  # what Spark allows a table


@dataclass(frozen=True)
class OutletStore:
    """`cold` is bucketed by Outlet_ID; `hot` has the other rows. The counts are those of the hot rows as written, so they
    bound whatever a filter leaves of them."""

    cold: DataFrame
    hot: DataFrame
    hot_outlets: int
    hot_grains: int

    def each(self, change: Callable[[DataFrame], DataFrame]) -> OutletStore:
        """The store after a filter or a projection, which must keep Outlet_ID."""
        return replace(self, cold=change(self.cold), hot=change(self.hot))

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)


def write_store(df: DataFrame, path: str, hot_rows: int = 2_000_000, bucket_rows: int = 2_000_000) -> None:
    """Writes `df` below `path`, a new folder. Outlets of more than `hot_rows` rows are kept apart; a bucket has about
    `bucket_rows` rows of the others."""
    spark = df.sparkSession
    counts = df.where("Outlet_ID IS NOT NULL").groupBy("Outlet_ID").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    hot = counts.where(F.col("n") > hot_rows).select("Outlet_ID")
    cold_rows = counts.where(F.col("n") <= hot_rows).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(cold_rows / bucket_rows))
    buckets = min(buckets, MAX_BUCKETS)
    mark = hot.withColumn("__hot", F.lit(True))
    flagged = df.join(mark, "Outlet_ID", "left").withColumn("__hot", F.col("__hot").isNotNull() | F.col("Outlet_ID").isNull())
    cold = flagged.where("NOT __hot").select(*df.columns)
    # one task per bucket, so one file per bucket
    (cold.repartition(buckets, "Outlet_ID").write.bucketBy(buckets, "Outlet_ID").sortBy("Outlet_ID").format("parquet")
     .option("path", f"{path}/cold").saveAsTable(_name()))
    flagged.where("__hot").select(*df.columns).write.parquet(f"{path}/hot")
    apart = spark.read.schema(df.schema).parquet(f"{path}/hot").where("Outlet_ID IS NOT NULL")
    grains = apart.select("Outlet_ID", "Sizes", month_of("Date").alias("m")).distinct().groupBy("Outlet_ID").agg(F.count("*").alias("n"))
    grains.agg(F.count("*").alias("hot_outlets"), F.coalesce(F.sum("n"), F.lit(0)).alias("hot_grains")).withColumn(
        "buckets", F.lit(buckets)).write.parquet(f"{path}/about")


def open_store(spark: SparkSession, path: str) -> OutletStore:
    """The store another session may have written: the bucketing is declared to this session's catalog."""
    about = spark.read.parquet(f"{path}/about").first()
    hot = spark.read.parquet(f"{path}/hot")
    name, columns = _name(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (Outlet_ID) SORTED BY (Outlet_ID) "
              f"INTO {about.buckets} BUCKETS LOCATION '{path}/cold'")
    return OutletStore(spark.table(name), hot, about.hot_outlets, about.hot_grains)


def _name() -> str:
    return f"outlet_store_{uuid.uuid4().hex}"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _with_totals(store: OutletStore) -> OutletStore:
    known = F.col("Month").isNotNull() & F.col("Sizes").isNotNull()
    w = Window.partitionBy("Outlet_ID", "Sizes", "Month")
    cold = store.cold.withColumn("Month", month_of("Date"))
    cold = cold.withColumn("Monthly_Quantity", F.when(known, F.sum(F.coalesce("Quantity", F.lit(0.0))).over(w)))
    totals = _small(S.grain_totals(store.hot.where("Outlet_ID IS NOT NULL")), store.hot_grains)
    hot = store.hot.withColumn("Month", month_of("Date")).join(totals, ["Outlet_ID", "Month", "Sizes"], "left")
    return replace(store, cold=cold, hot=hot.select(*cold.columns))


def _with_slabs(store: OutletStore, rules: SlabRules) -> OutletStore:
    if rules.mode != "define":
        return store
    slab = S.slab_of("Sizes", "Monthly_Quantity", rules)
    return _with_totals(store).each(lambda df: df.withColumn("Slab", slab).drop("Month", "Monthly_Quantity"))


def grain_back_join(store: OutletStore) -> DataFrame:
    """As scope.grain_back_join: every row with its outlet-month-size quantity, null without outlet, date or size."""
    return _with_totals(store).rows()


def assign_slabs(store: OutletStore, rules: SlabRules) -> DataFrame:
    """As scope.assign_slabs, without moving a row of the fact."""
    return _with_slabs(store, rules).rows()


def step_scope(store: OutletStore, rfm: DataFrame, segments=(), outlet_classes=(), outlet_ids=(), slabs=(),
               rules: SlabRules = SlabRules()) -> tuple[DataFrame, DataFrame]:
    """As scope.step_scope. Whether an outlet has a row of a chosen class is a second window over the rows sorted for
    the first; among the hot rows it is a list of outlets."""
    chosen = rfm
    if segments:
        chosen = chosen.where(F.col("RFM_Segment").isin(*segments))
    if outlet_ids:
        chosen = chosen.where(F.col("Outlet_ID").isin(*[str(o) for o in outlet_ids]))
    scoped = _with_slabs(store.each(lambda df: S.semi_outlets(df, chosen)), rules)
    groups = S.group_labels(outlet_classes)
    if groups:
        of_class = outlet_group("Final_Outlet_Classification").isin(*groups)
        cold = scoped.cold.withColumn("__has", F.max(of_class).over(Window.partitionBy("Outlet_ID"))).where("__has").drop("__has")
        outlets = store.hot.where(of_class).select("Outlet_ID").distinct()
        scoped = replace(scoped, cold=cold, hot=S.semi_outlets(scoped.hot, _small(outlets, store.hot_outlets)))
    every_slab = scoped.rows()
    kept = every_slab.where(allowed_slab("Slab"))
    return (kept.where(F.col("Slab").isin(*slabs)) if slabs else kept), every_slab
