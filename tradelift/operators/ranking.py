"""Places in a total order without sorting into one task: row numbers, and pages found by order statistics.

An order is a list of (column, descending, nulls last), the leading column first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.functions.lineage import cut

#: Keys that a narrowing step draws (expected number), and rows that are sorted without another one.
DRAWN, DIRECT = 4_000, 50_000
#: Bits of a monotonic id that number the rows of one partition.
ROW_BITS = 33


def sort_columns(order) -> list[Column]:
    def one(name, descending, last):
        c = F.col(name)
        return (c.desc_nulls_last() if last else c.desc_nulls_first()) if descending else c.asc_nulls_last() if last else c.asc_nulls_first()
    return [one(*o) for o in order]


def numbered(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Adds `name`, the row number from 1 under `order`.

    Spark sorts into ranges of keys and each row keeps its place in its range; a window then runs over one
    row per range only. Rows alike in every column of `order` are numbered in any order. An empty table stays empty."""
    ranged = cut(df.orderBy(*sort_columns(order)).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", ROW_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows")).select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    own = F.col("__place").bitwiseAND((1 << ROW_BITS) - 1)
    return ranged.withColumn("__part", part).join(ranges, "__part").select(*df.columns, (F.col("__before") + own + 1).alias(name))


def _after(order, at) -> Column:
    """Whether a row comes after the key `at`."""
    out = F.lit(False)
    for name, descending, last in reversed(order):
        c, v = F.col(name), at[name]
        if v is None:
            beyond, same = (F.lit(False) if last else c.isNotNull()), c.isNull()
        else:
            beyond, same = F.coalesce(c < F.lit(v) if descending else c > F.lit(v), F.lit(last)), F.coalesce(c == F.lit(v), F.lit(False))
        out = beyond | (same & out)
    return out


def _in_order(keys, order):
    for name, descending, last in reversed(order):
        def place(row):
            v = row[name]
            odd = isinstance(v, float) and math.isnan(v)
            return ((v is None) == (last != descending), odd, 0 if v is None or odd else v)
        keys = sorted(keys, key=place, reverse=descending)
    return keys


def page(df: DataFrame, order, offset: int, size: int, rows: int, direct: int = DIRECT, steps: list | None = None) -> DataFrame:
    """Rows `offset` to `offset + size` of `df`, which has `rows` rows, under `order`.

    A drawn set of keys tells which range of keys holds the page; counting what lies before and inside is one aggregate, and
    only the range is written for the next step, until at most `direct` rows (or four pages) are left to be sorted.
    The draw decides how fast it narrows, never the result: a range that misses part of the page is joined
    with its neighbour. Rows with one and the same key cannot be told apart; then the range is sorted as it is.
    `steps`, if given, receives the rows left after each step."""
    kept, left = df, rows
    names = [o[0] for o in order]
    end = min(offset + size, rows)
    while left > max(direct, 4 * size) and offset < end:
        drawn = _in_order(kept.select(*names).sample(min(1.0, DRAWN / left), seed=left).collect(), order)
        slack = 1.5 * math.sqrt(len(drawn)) + 2
        first, last = math.floor(offset / left * len(drawn) - slack), math.ceil(end / left * len(drawn) + slack)
        past_low = _after(order, drawn[first]) if first >= 0 else F.lit(True)
        past_high = _after(order, drawn[last]) if last < len(drawn) else F.lit(False)
        n = kept.agg(F.count_if(~past_low).alias("before"), F.count_if(past_low & ~past_high).alias("inside")).first()
        low, high = offset >= n.before, end <= n.before + n.inside
        now = left - (n.before if low else 0) - (left - n.before - n.inside if high else 0)
        if now == left:
            break
        if low:
            kept, offset, end = kept.where(past_low), offset - n.before, end - n.before
        if high:
            kept = kept.where(~past_high)
        kept, left = cut(kept), now
        if steps is not None:
            steps.append(left)
    return kept.orderBy(*sort_columns(order)).offset(offset).limit(size)
