"""The month table against plain sums: restarts, late rows, merging, old versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradelift.functions.columns import month_of
from tradelift.streaming import drops
from tradelift.streaming.table import MonthTable, ingest

SCHEMA = ("Date date, Outlet_ID string, Bill_No string, Sizes string, Slab string, Quantity double, Net_Amt double, "
          "SalesValue_atBasicRate double, TotalDiscount double")


def drop(spark, rows):
    return spark.createDataFrame([(d, o, "b", "12-ML", "slab1", q, q * 2, q, 0.0) for d, o, q in rows], SCHEMA)


def plain(df):
    return sorted(map(tuple, df.groupBy("Sizes", "Outlet_ID", month_of("Date").alias("period")).agg(
        F.sum("Quantity"), F.sum("Net_Amt"), F.count("*")).collect()), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


DROPS = [[(dt.date(2024, m, 3), o, float(m)) for o in ("a", "b", None)] + [(dt.date(2024, m, 9), "a", 1.0)] for m in range(1, 6)]
LATE = [(dt.date(2023, 12, 1), "a", 5.0), (dt.date(2024, 1, 8), "a", 7.0), (dt.date(2024, 4, 8), "a", 2.0), (None, "a", 3.0)]


def test_batches_late_rows_and_merging_equal_the_batch_result(spark, tmp_path):
    table, seen = MonthTable(spark, str(tmp_path / "t"), fan_in=3), []
    with pytest.raises(ValueError):
        table.read()
    for i, part in enumerate([*DROPS, LATE]):
        seen += part
        assert table.apply(drop(spark, part), i, "q") == i + 1
        if i in (1, 2, 5):  # before and after the first merge, and with late rows
            assert rows(table.read()) == plain(drop(spark, seen))
    late = [r for r in LATE if r[0] and r[0] < dt.date(2024, 3, 1)]
    assert rows(table.late_rows()) == plain(drop(spark, late))
    assert rows(table.read(late=False)) == plain(drop(spark, [r for r in seen if r not in late]))
    assert rows(table.read(version=2)) == plain(drop(spark, DROPS[0] + DROPS[1]))
    assert rows(table.changes(6)) == plain(drop(spark, [r for r in seen if r[1] == "a" and (r[0] is None or r[0].month in (12, 1, 4))]))
    assert len({r.folder for r in table._live()}) <= 5


def test_batches_count_once(spark, tmp_path):
    table = MonthTable(spark, str(tmp_path / "t"), fan_in=2)
    a, b = drop(spark, DROPS[0]), drop(spark, DROPS[1])
    table.apply(a, 0, "q")
    table.apply(b, 1, "q")  # merges both
    assert table.apply(a, 0, "q") == 2 and table.apply(b, 1, "q") == 2
    table.apply(a, 0, "other")  # another query has batches of its own, also once merged
    table.apply(b, 1, "other")
    assert table.apply(b, 1, "q") == 4 and table.apply(a, 0, "other") == 4
    assert rows(table.read()) == plain(a.unionByName(b).unionByName(a).unionByName(b))
    assert table.apply(a.where("false"), 2, "q") == 4


def test_a_batch_that_failed_before_its_manifest(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "in")
    table = MonthTable(spark, str(tmp_path / "t"))
    drop(spark, DROPS[0]).coalesce(1).write.parquet(f"{src}/d0.parquet")
    ingest(drops.drop_stream(spark, src), table, str(tmp_path / "c"))
    drop(spark, DROPS[1]).coalesce(1).write.parquet(f"{src}/d1.parquet")
    broken = MonthTable(spark, str(tmp_path / "t"))
    monkeypatch.setattr(broken, "_publish", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        ingest(drops.drop_stream(spark, src), broken, str(tmp_path / "c"))
    assert rows(table.read()) == plain(drop(spark, DROPS[0]))
    ingest(drops.drop_stream(spark, src), table, str(tmp_path / "c"))
    assert table.version() == 2 and rows(table.read()) == plain(drop(spark, DROPS[0] + DROPS[1]))
