"""Writing result tables and keeping saved reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REPORT_STEPS = ("step4", "step5")


def write_result_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv", partition_by=()) -> list[str]:
    """Each named table below `folder`; returns the paths written."""
    if fmt not in ("csv", "parquet"):
        raise ValueError("fmt must be csv or parquet")
    paths = []
    for name, df in tables.items():
        w = df.write.mode("overwrite").partitionBy(*[c for c in partition_by if c in df.columns])
        w = w.option("header", True) if fmt == "csv" else w
        path = f"{folder}/{name}"
        w.format(fmt).save(path)
        paths.append(path)
    return paths


def save_reports(reports: DataFrame, payload: DataFrame, folder: str) -> None:
    """Appends reports (report_key, step, report_name, reference_mode, metadata map, created_at) and
    their payload rows (report_key, item, value). Both are append-only tables."""
    ok = F.lower(F.trim("step")).isin(*REPORT_STEPS) & (F.trim("report_name") != "")
    checked = reports.withColumn("step", F.when(
        ok, F.lower(F.trim("step"))).otherwise(F.raise_error(F.lit("a report needs a name and step4 or step5"))))
    payload.write.mode("append").parquet(f"{folder}/payload")
    checked.withColumn("report_name", F.trim("report_name")).write.mode("append").parquet(f"{folder}/reports")


def list_reports(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    """The newest `limit` reports."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return spark.read.parquet(f"{folder}/reports").orderBy(F.desc("created_at"), F.desc("report_key")).limit(int(limit))


def get_report(spark: SparkSession, folder: str, report_key: str) -> DataFrame:
    head = spark.read.parquet(f"{folder}/reports").where(F.col("report_key") == report_key)
    rows = spark.read.parquet(f"{folder}/payload").where(F.col("report_key") == report_key)
    return head.join(rows, "report_key", "left")
