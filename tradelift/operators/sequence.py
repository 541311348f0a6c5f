"""Operators that walk a calendar-ordered series per group.

Windows are partitioned by the group; what depends on the row before's result is a pass over sorted rows that carries
its state from batch to batch."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tradelift.functions.columns import clip, round_step


def _over(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def _whole(keys, order=None):
    w = Window.partitionBy(*keys)
    return w if order is None else w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def lag_base(df: DataFrame, keys, order, value="base_discount_pct", out="lag1_base_discount_pct") -> DataFrame:
    """The previous value; the first row repeats its own."""
    return df.withColumn(out, F.coalesce(F.lag(value).over(_over(keys, order)), F.col(value)))


def pct_change(df: DataFrame, keys, order, columns: dict[str, str], fill: float | None = 0.0) -> DataFrame:
    """Percent change to the row before; the first row and a zero base give `fill`."""
    w = _over(keys, order)

    def change(c):
        prev = F.lag(c).over(w)
        r = F.when(prev != 0, (F.col(c) / prev - 1) * 100.0)
        return r if fill is None else F.coalesce(r, F.lit(fill))

    return df.withColumns({out: change(c) for c, out in columns.items()})


def fill_gaps(df: DataFrame, keys, order, columns) -> DataFrame:
    """Forward, then backward fill."""
    w = _over(keys, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns})


def interpolate(df: DataFrame, keys, order, value: str, out: str) -> DataFrame:
    """Linear between the known neighbours by row position; the ends repeat the nearest value."""
    w = _over(keys, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = df.withColumn("__i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct("__i", value))
    seen = pos.withColumn("__a", F.last(known, True).over(back)).withColumn("__b", F.first(known, True).over(ahead))
    a, b, ai, bi = F.col(f"__a.{value}"), F.col(f"__b.{value}"), F.col("__a.__i"), F.col("__b.__i")
    line = a + (b - a) * (F.col("__i") - ai) / F.nullif(bi - ai, F.lit(0))
    return seen.withColumn(out, F.coalesce(F.col(value), line, a, b)).drop("__i", "__a", "__b")


def iqr_fence(df: DataFrame, keys, value: str, out: str, min_points: int = 8) -> DataFrame:
    """Within each key, values outside 1.5 interquartile ranges become null (from 8 points on)."""
    w = _whole(keys)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    d = df.withColumn("__q", q).withColumn("__n", F.count(value).over(w))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    outside = (F.col("__n") >= min_points) & (hi > lo) & (
        (F.col(value) < lo - 1.5 * (hi - lo)) | (F.col(value) > hi + 1.5 * (hi - lo)))
    return d.withColumn(out, F.when(~F.coalesce(outside, F.lit(False)), F.col(value))).drop("__q", "__n")


def segment_median_min(df: DataFrame, keys, order, value: str, out: str = "candidate") -> DataFrame:
    """Medians of row positions 1-10, 11-20 and 21+ of each key; the smallest one."""
    d = df.withColumn("__r", F.row_number().over(_over(keys, order)))
    r = F.col("__r")
    parts = [r <= 10, (r > 10) & (r <= 20), r > 20]
    return d.groupBy(*keys).agg(F.least(*[F.median(F.when(p, F.col(value))) for p in parts]).alias(out))


def _carry(df: DataFrame, keys, order, fields, start, step, outputs: dict[str, T.DataType]) -> DataFrame:
    """Adds `outputs` by a pass over rows sorted by group and order. `step(state, *fields)` gives the next state and the
    row's outputs; `start` is the state before a group's first row. The state goes from one Arrow batch to the next, so
    a task holds a batch and one state however long a series is. All other columns pass through as they are."""
    keys, fields = list(keys), list(fields)
    schema = T.StructType([*df.schema, *[T.StructField(c, t) for c, t in outputs.items()]])
    types = [to_arrow_type(t) for t in outputs.values()]

    def run(batches):
        group, state = None, start
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            made = []
            for at, *values in zip(ids, *[batch.column(f).to_pylist() for f in fields]):
                if at != group:
                    group, state = at, start
                state, row = step(state, *values)
                made.append(row)
            added = [pa.array(c, t) for c, t in zip(zip(*made), types)] if made else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    parts = df.repartition(*keys) if keys else df.coalesce(1)
    return parts.sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def base_hysteresis(df: DataFrame, keys, order, value: str, up: float = 1.0, down: float = 1.0,
                    out: str = "base_discount_pct", moved: str | None = None) -> DataFrame:
    """Carries a base along the series. It moves only by a step of at least `up` or `down`; the
    result lies in 0..100. A missing value keeps the base (0 before the first)."""
    up, down = max(0.0, up), max(0.0, down)

    def step(base, value):
        new = value if value is not None else 0.0 if base is None else base
        if base is not None and -down < new - base < up:
            new = base
        return new, (min(max(new, 0.0), 100.0), base is not None and abs(new - base) > 1e-9)

    d = df.withColumn("__from", F.col(value).cast("double"))
    d = _carry(d, keys, order, ["__from"], None, step, {"__base": T.DoubleType(), "__moved": T.BooleanType()}).drop("__from")
    d = d.withColumn(out, F.col("__base"))
    return (d.withColumn(moved, F.col("__moved")) if moved else d).drop("__base", "__moved")


def rolling_base(df: DataFrame, keys, order, value: str, rolling: int = 12, validation: int = 8, up: float = 1.0,
                 down: float = 1.0, percentile: float = 35.0, out: str = "base", moved: str = "moved") -> DataFrame:
    """Trailing-percentile base. It jumps to the percentile when that is `up` or `down` away, 60% of
    the next `validation` values agree and the last jump is a window ago; else it drifts by at most
    0.15 per row."""
    validation, drift = max(3, validation), 0.15
    w = _over(keys, order)
    d = interpolate(df, keys, order, value, "__x")
    d = d.withColumns({
        "__cand": F.percentile("__x", F.lit(percentile / 100.0)).over(w.rowsBetween(-(max(3, rolling) - 1), 0)),
        "__fut": F.collect_list("__x").over(w.rowsBetween(0, validation - 1)),
        "__i": F.row_number().over(w),
        "__n": F.count("*").over(_whole(keys)),
    })
    # The start value is the percentile of the first full window, found on that window's last row.
    window = F.greatest(F.lit(3), F.least(F.lit(rolling), F.col("__n")))
    start = F.max(F.when(F.col("__i") == F.least(window, F.col("__n")), F.col("__cand"))).over(_whole(keys))
    d = d.withColumn("__start", start).withColumn("__cool", F.greatest(F.lit(1), window).cast("int"))

    def step(state, first, i, cand, future, cool):
        base, last = (first, 1 - cool) if state is None else state
        if None in (base, cand):  # nothing known in the whole series
            return (base, last), (base, False)
        need = math.ceil(len(future) * 0.6)
        ready = len(future) >= validation and i - last >= cool
        rise = cand >= base + up and sum(v >= base + up * 0.6 for v in future) >= need
        fall = cand <= base - down and sum(v <= base - down * 0.6 for v in future) >= need
        jump = ready and (rise or fall)
        base = cand if jump else base + min(max(cand - base, -drift), drift)
        return (base, i if jump else last), (min(max(base, 0.0), 100.0), jump)

    d = _carry(d, keys, order, ["__start", "__i", "__cand", "__fut", "__cool"], None, step,
               {"__base": T.DoubleType(), "__moved": T.BooleanType()})
    d = d.withColumn(out, F.col("__base")).withColumn(moved, F.col("__moved"))
    return d.drop("__x", "__cand", "__fut", "__i", "__n", "__start", "__cool", "__base", "__moved")


def regimes(df: DataFrame, keys, order, value="base_discount_pct", step: float = 0.5) -> DataFrame:
    """Adds the quantised level, the regime number, the position inside the regime and the level of
    the regime before."""
    w = _over(keys, order)
    d = df.withColumn("level", round_step(value, step))
    d = d.withColumn("__prev", F.lag("level").over(w))
    d = d.withColumn("regime_id", F.sum(
        F.when(F.abs(F.col("level") - F.col("__prev")) > 1e-9, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "regime_id").orderBy(order)
    return d.withColumns({
        "hold_idx": F.row_number().over(inside),
        "prev_level": F.first("__prev").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    }).drop("__prev")


def regime_islands(df: DataFrame, keys, order, value="base_discount_pct", step: float = 0.5) -> DataFrame:
    """One row per regime: start, end, length, level."""
    return regimes(df, keys, order, value, step).groupBy(*keys, "regime_id").agg(
        F.min(order).alias("start_period"), F.max(order).alias("end_period"),
        F.count("*").alias("months"), F.first("level").alias("level"))


def latest_per_group(df: DataFrame, keys, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def top_k_per_group(df: DataFrame, keys, by, k: int, ties=()) -> DataFrame:
    """The k largest per group. With few rows per key a window is enough; Spark keeps only k per
    task and key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *[F.asc(t) for t in ties])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lead_two_period(df: DataFrame, keys, order, revenue="predicted_revenue", baseline="baseline_revenue",
                    spend="spend") -> DataFrame:
    """Adds increment and ROI over this and the next row."""
    w = _over(keys, order)
    two = {c: F.col(c) + F.coalesce(F.lead(c).over(w), F.lit(0.0)) for c in (revenue, baseline)}
    inc = two[revenue] - two[baseline]
    return df.withColumn("incremental_revenue_2mo", inc).withColumn(
        "roi_2mo", F.col("incremental_revenue_2mo") / F.nullif(spend, F.lit(0.0)))


def trailing_series(df: DataFrame, keys, order, value: str, n: int) -> DataFrame:
    """The last n values per group as rows (idx 0..n-1); a shorter series repeats its first value in
    front."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    tail = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    s = tail.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda e: e[value]).alias("s"))
    pad = F.array_repeat(F.element_at("s", 1), F.lit(n) - F.size("s"))
    return s.select(*keys, F.posexplode(F.concat(pad, F.col("s"))).alias("idx", value))


def expanding_moments(df: DataFrame, keys, order, y: str, xs, include_current: bool = True) -> DataFrame:
    """Running count, sums, squares and cross products for every prefix of each series."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    return df.withColumns({name: F.coalesce(F.sum(e).over(w), F.lit(0.0)) for name, e in moment_columns(y, xs).items()})


def moment_columns(y: str, xs) -> dict:
    """Name -> row expression whose sum is the moment."""
    Y = F.col(y).cast("double")
    out = {"m_n": F.lit(1.0), "m_y": Y, "m_yy": Y * Y}
    for i, a in enumerate(xs):
        A = F.col(a).cast("double")
        out[f"m_x{i}"] = A
        out[f"m_xy{i}"] = A * Y
        for j in range(i, len(xs)):
            out[f"m_xx{i}_{j}"] = A * F.col(xs[j]).cast("double")
    return out
