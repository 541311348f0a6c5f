"""Row numbers and pages against sorting in Python, also with nulls, ties and hot keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tradelift.operators import ranking, rfm as R, sketches

SCHEMA = "v double, name string, i bigint"


def sample(n, hot=False):
    rng = random.Random(n)
    value = lambda: rng.choice([None, float("nan"), 1.5, -2.0] + [rng.random() * 100 for _ in range(20)])
    return [(7.0 if hot and k % 3 else value(), rng.choice([None, "a", "B", "é", "z"]), k) for k in range(n)]


def place(row, order):
    """Sort key for (name, descending, nulls last) with numbers for names: index of the column."""
    out = []
    for c, descending, last in order:
        v = row[c]
        text = v if isinstance(v, str) else ""
        nan = isinstance(v, float) and math.isnan(v)
        rank = (nan, 0 if v is None or nan or text else v, text)
        sign = -1 if descending else 1
        out.append(((v is None) == last, sign * rank[0], sign * rank[1], [sign * ord(x) for x in text] + ([1] if descending else [-1])))
    return out


@pytest.mark.parametrize("order", [
    [("v", True, True), ("name", False, False), ("i", False, False)],
    [("v", False, True), ("name", True, True), ("i", True, False)],
    [("name", False, False), ("v", True, False), ("i", False, False)],
])
def test_numbers_and_pages(spark, order):
    rows = sample(3000, hot=True)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    at = [("v name i".split().index(c), d, n) for c, d, n in order]
    want = [r[2] for r in sorted(rows, key=lambda r: place(r, at))]
    got = ranking.numbered(df, order, "k").collect()
    assert [r.i for r in sorted(got, key=lambda r: r.k)] == want and sorted(r.k for r in got) == list(range(1, 3001))
    for offset, size in [(0, 10), (1490, 25), (2990, 25), (5000, 5), (700, 1)]:
        steps = []
        assert [r.i for r in ranking.page(df, order, offset, size, 3000, direct=50, steps=steps).collect()] == want[offset:offset + size]
        assert offset > 3000 or steps


def test_a_deep_page_moves_about_its_rows(spark):
    df = spark.range(400_000).select(F.xxhash64("id").alias("v"), "id")
    steps = []
    order = [("v", False, False), ("id", False, False)]
    got = ranking.page(df, order, 300_000, 50, 400_000, steps=steps).collect()
    assert steps[-1] <= ranking.DIRECT and len(steps) <= 2
    assert [r.id for r in got] == [r.id for r in df.orderBy("v").offset(300_000).limit(50).collect()]


def test_rows_of_one_key_and_empty_tables(spark):
    same = spark.createDataFrame([(1.0, "a", 1)] * 500, SCHEMA)
    order = [("v", False, False)]
    assert ranking.page(same, order, 490, 20, 500, direct=10).count() == 10
    assert sorted(r.rank for r in ranking.numbered(same, order).collect()) == list(range(1, 501))
    none = same.limit(0)
    assert ranking.numbered(none, order).columns == ["v", "name", "i", "rank"] and ranking.numbered(none, order).count() == 0
    assert ranking.page(none, order, 0, 5, 0).count() == 0


def test_sketches_merge_and_keep_their_error(spark):
    rng = random.Random(4)
    rows = [(f"2024-{1 + k % 6:02d}-15", f"o{rng.randint(0, 20000)}", rng.choice("xy")) for k in range(60_000)] + [("2024-01-02", None, "x")]
    df = spark.createDataFrame(rows, "d string, outlet string, k string").withColumn("Date", F.to_date("d"))
    months = sketches.month_sketches(df, {"outlets": "outlet"}, ["k"])
    assert months.count() == 12
    got = {r.k: r for r in sketches.merged(months, ["outlets"], ["k"]).collect()}
    direct = {r.k: r for r in df.groupBy("k").agg(F.count_distinct("outlet").alias("n"), sketches.estimate("outlet").alias("e"), F.count("*").alias("rows")).collect()}
    for k in "xy":
        assert got[k].outlets == direct[k].e and got[k].rows == direct[k].rows
        assert abs(direct[k].e / direct[k].n - 1) < 4 * sketches.standard_error()
    import datetime as dt
    part = sketches.merged(months, ["outlets"], first=dt.date(2024, 2, 1), last=dt.date(2024, 3, 1)).first()
    true = len({o for d, o, _ in rows if d[5:7] in ("02", "03")})
    assert abs(part.outlets / true - 1) < 4 * sketches.standard_error() and part.rows == 20_000
    empty = sketches.merged(months.limit(0), ["outlets"]).first()
    assert (empty.rows, empty.outlets) == (0, 0)
    only_null = df.where("outlet IS NULL").agg(sketches.estimate("outlet").alias("n"), sketches.estimate(sketches.key_of("outlet", "k")).alias("pair")).first()
    assert (only_null.n, only_null.pair) == (0, 1)
