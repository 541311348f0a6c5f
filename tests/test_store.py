"""The fact by outlet: same rows as the plain operators, no exchange of the fact."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tradelift.operators import scope as S, store as ST
from tradelift.schema import SlabRules

RULES = SlabRules("define", per_size={"12-ML": (8.0, 32.0), "18-ML": (8.0, 16.0)})
SCHEMA = "Outlet_ID string, Date date, Sizes string, Quantity double, Final_Outlet_Classification string, n int"


def fact(spark, rows=900):
    """A third of the rows are one outlet's, some lack a key or a quantity, some outlets have rows of two classes."""
    rng, out = random.Random(7), []
    for i in range(rows):
        outlet = "hot" if i % 3 == 0 else f"o{rng.randrange(40)}"
        out.append([outlet, dt.date(2024, rng.randrange(1, 4), rng.randrange(1, 28)), rng.choice(["12-ML", "18-ML"]),
                    float(rng.randrange(1, 9)), rng.choice(["WH", "SS", "SS", None]) if outlet in ("o1", "hot") else "SS", i])
        if i % 50 < 4:
            out[-1][i % 50] = None
    return spark.createDataFrame(out, SCHEMA)


def opened(spark, df, path, hot_rows=100):
    ST.write_store(df, path, hot_rows)
    return ST.open_store(spark, path)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    df = fact(spark)
    return df, opened(spark, df, str(tmp_path_factory.mktemp("store") / "s"))


def test_stored_slabs_equal_plain_ones(kept):
    df, store = kept
    assert store.hot_outlets == 1 and store.hot.where("Outlet_ID = 'hot'").count() == df.where("Outlet_ID = 'hot'").count()
    assert store.cold.where("Outlet_ID = 'hot' OR Outlet_ID IS NULL").count() == 0
    assert rows(ST.grain_back_join(store)) == rows(S.grain_back_join(df))
    assert rows(ST.assign_slabs(store, RULES)) == rows(S.assign_slabs(df, RULES))
    some = store.each(lambda d: d.where("Quantity > 3"))
    assert rows(ST.assign_slabs(some, RULES)) == rows(S.assign_slabs(df.where("Quantity > 3"), RULES))


def test_stored_scope_equals_plain_one(kept):
    df, store = kept
    rfm = df.where("Outlet_ID IS NOT NULL").select("Outlet_ID").distinct().withColumn(
        "RFM_Segment", F.when(F.col("Outlet_ID").isin("hot", "o1", "o2", "o3"), "a").otherwise("b"))
    for choice in ((("a",), ("WH",), (), ("slab1",)), ((), (), ("o1", "o5", "hot"), ()), (("a", "b"), ("SS",), (), ())):
        got, want = ST.step_scope(store, rfm, *choice, RULES), S.step_scope(df, rfm, *choice, RULES)
        assert [rows(g) for g in got] == [rows(w) for w in want]


def test_no_fact_row_moves(kept):
    plan = ST.assign_slabs(kept[1], RULES)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning.*\n\W*(\w+)", plan)
    assert moved == ["HashAggregate"]  # totals of the hot rows, combined before
    assert plan.count("Bucketed: true") == 1 and "SortMergeJoin" not in plan


def test_empty_and_all_hot_stores(spark, tmp_path):
    df = fact(spark)
    empty = opened(spark, df.where("false"), str(tmp_path / "e"))
    assert ST.assign_slabs(empty, RULES).count() == 0
    every = opened(spark, df, str(tmp_path / "h"), hot_rows=0)
    assert every.cold.count() == 0 and rows(ST.assign_slabs(every, RULES)) == rows(S.assign_slabs(df, RULES))


def plain_options(df, rfm, segments, classes, slabs):
    """The four lists by a pass each."""
    inside = rfm.where(F.col("RFM_Segment").isin(*segments)) if segments else rfm
    part, groups = S.semi_outlets(df, inside), S.group_labels(classes)
    of_class = S.outlet_group("Final_Outlet_Classification").isin(*groups) if groups else F.lit(True)
    value = lambda d, c: {r[0] for r in d.select(c).distinct().collect() if r[0]}
    out = {("rfm_segments", v) for v in value(rfm, "RFM_Segment")}
    out |= {("outlet_classifications", v) for v in value(part, S.outlet_group("Final_Outlet_Classification"))}
    out |= {("slabs", v) for v in value(S.drop_slab0(S.assign_slabs(part.where(of_class), RULES)), "Slab")}
    kept, _ = S.step_scope(df, rfm, segments, classes, (), slabs, RULES)
    return out | {("matching_outlets", str(len(value(kept, "Outlet_ID"))))}


def test_options_from_profiles(spark, tmp_path):
    fact(spark).write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    rfm = df.where("Outlet_ID IS NOT NULL").select("Outlet_ID").distinct().withColumn(
        "RFM_Segment", F.when(F.col("Outlet_ID").isin("hot", "o1", "o2"), "a").otherwise("b"))
    rfm = rfm.unionByName(spark.createDataFrame([("unsold", "c")], "Outlet_ID string, RFM_Segment string"))
    for choice in (((), (), ()), (("a",), ("WH",), ("slab1", "slab2")), (("b",), ("WH",), ()), (("c",), (), ())):
        got = {tuple(r) for r in S.discount_options(df, rfm, *choice, RULES).collect()}
        assert got == plain_options(df, rfm, *choice)
    rfm.write.parquet(str(tmp_path / "r"))
    plan = S.discount_options(df, spark.read.parquet(str(tmp_path / "r")), ("a",), ("WH",), (), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and len(re.findall(r"FileScan.*Quantity", plan)) == 1
