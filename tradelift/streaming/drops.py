"""Taking in new monthly drops without reading old ones again."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelift.functions.columns import month_of
from tradelift.schema import FACT_SCHEMA
from tradelift.sources.ingest import tidy


def drop_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, scope=None, schema=FACT_SCHEMA) -> DataFrame:
    """New parquet files below `folder` as a stream in fact shape."""
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder))
    return tidy(raw, scope)


def ingest_month_sums(stream: DataFrame, out: str, checkpoint: str, keys=("Sizes", "Outlet_ID")) -> None:
    """Runs the stream over everything new and appends each batch's own sums per month and keys.

    Sums add up, so a batch needs no state and a late or out-of-order drop is never lost. A batch's folder is named
    after the query, whose id lives in its checkpoint, and the batch: one that runs twice after a failure overwrites
    its own folder, and a new checkpoint overwrites none."""
    started, name = Event(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        g = batch.groupBy(*keys, month_of("Date").alias("period")).agg(
            F.sum("Quantity").alias("quantity"), F.sum("Net_Amt").alias("net_amt"), F.count("*").alias("rows"))
        g.write.mode("overwrite").parquet(f"{out}/query={name[0]}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    name.append(q.id)
    started.set()
    q.awaitTermination()


def compact_month_sums(spark: SparkSession, out: str, to: str, keys=("Sizes", "Outlet_ID")) -> None:
    """All finished batches of `out` as one table in the new folder `to`. Readers switch to `to` and later batches go
    below it; the old folder may then be dropped."""
    month_sums(spark, out, keys).write.parquet(f"{to}/query=compacted/batch=0")


def month_sums(spark: SparkSession, out: str, keys=("Sizes", "Outlet_ID")) -> DataFrame:
    """The month table as of the last finished batch."""
    return spark.read.parquet(out).groupBy(*keys, "period").agg(
        F.sum("quantity").alias("quantity"), F.sum("net_amt").alias("net_amt"), F.sum("rows").alias("rows"))


def watermarked_days(stream: DataFrame, keys=("Sizes", "Slab"), lateness: str = "62 days") -> DataFrame:
    """Day windows per key with bounded state, for feeds whose lateness is known. The driver's NTZ
    times must be plain timestamps before a watermark can be set."""
    t = stream.withColumn("ts", F.col("Date").cast("timestamp")).withWatermark("ts", lateness)
    return t.groupBy(F.window("ts", "1 day"), "Date", *keys).agg(F.sum("Quantity").alias("quantity"), F.count("*").alias("rows"))


def ingest_days(days: DataFrame, out: str, checkpoint: str) -> int:
    """Runs the windowed stream in update mode; every batch writes the rows it changed. Returns how many rows came
    later than the watermark allows and are therefore missing; ingest_month_sums() keeps such rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.drop("window").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (days.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])


def latest_days(spark: SparkSession, out: str, keys=("Sizes", "Slab")) -> DataFrame:
    """The newest version of each updated day row."""
    d = spark.read.parquet(out)
    return d.groupBy("Date", *keys).agg(F.max_by(F.struct("quantity", "rows"), "batch").alias("r")).select("Date", *keys, "r.*")
