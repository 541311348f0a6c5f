"""Discount ladders: one value per slab, rising with the slab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.functions.columns import clip, slab_number
from tradelift.schema import LADDER_MAX, LADDER_MIN

ANCHORS = ["last_3m_exact", "same_season_last_year", "most_common_historical_ladder",
           "highest_historical_promo_ladder", "lowest_historical_promo_ladder"]


def in_range(c, default=None) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    v = F.when(F.isnan(v), None).otherwise(v)
    return clip(F.coalesce(v, F.lit(LADDER_MIN) if default is None else default), LADDER_MIN, LADDER_MAX)


def _by_slab(keys, slab="Slab"):
    return Window.partitionBy(*keys).orderBy(slab_number(slab), slab)


def enforce_ladder(df: DataFrame, keys, value="value", whole: bool = False) -> DataFrame:
    """Clamped to 5..30 and never falling from slab to slab; `whole` rounds half-even to integers."""
    v = F.rint(F.col(value)) if whole else F.col(value)
    run = F.max(in_range(v)).over(_by_slab(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(value, run if whole else F.round(run, 2))


def enforce_bounded(df: DataFrame, keys, value="value", low="min_pct", high="max_pct") -> DataFrame:
    """Whole-number ladder inside per-cell bounds. A group whose bounds cross gets null throughout.

    Lows rise with the slab and highs are pulled down from behind; the ladder is then the running
    maximum of each value held inside its own bounds."""
    w = _by_slab(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    lo = in_range(F.rint(F.col(low)), F.lit(LADDER_MIN))
    hi = in_range(F.rint(F.col(high)), F.lit(LADDER_MAX))
    d = df.withColumns({"__own": lo > hi, "__lo": F.max(lo).over(back), "__hi": F.min(hi).over(ahead)})
    seed = in_range(F.rint(F.col(value)), F.col("__lo"))
    held = F.least(F.col("__hi"), F.greatest(seed, F.col("__lo")))
    broken = F.bool_or(F.col("__own") | (F.col("__lo") > F.col("__hi"))).over(Window.partitionBy(*keys))
    d = d.withColumns({"__v": held, "__bad": broken})
    return d.withColumn(value, F.when(~F.col("__bad"), F.max("__v").over(back))).drop("__own", "__lo", "__hi", "__v", "__bad")


def check_bounds(bounds: DataFrame) -> None:
    """Raises when a cell's min exceeds its max. One small table; only the first fault is fetched."""
    bad = bounds.where("min_pct > max_pct").limit(1).collect()
    if bad:
        b = bad[0]
        raise ValueError(f"min {b.min_pct} > max {b.max_pct} for {b.period} {b.Sizes} {b.Slab}")


def strict_ladder(df: DataFrame, keys, value="value") -> DataFrame:
    """Clamped to 5..30 with at least one point between neighbouring slabs.

    Each value less its position must not fall, which is a running maximum; the cap leaves room
    for the slabs above."""
    w = _by_slab(keys)
    i = F.row_number().over(w) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    d = df.withColumns({"__i": i, "__n": n})
    d = d.withColumn("__z", F.max(F.round(in_range(value), 2) - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cap = LADDER_MAX - (F.col("__n") - 1)
    return d.withColumn(value, F.round(F.least(F.col("__z"), cap) + F.col("__i"), 2)).drop("__i", "__n", "__z")


def history_ladders(months: DataFrame, value="base_discount_pct") -> DataFrame:
    """Month rows with the month's completeness, average and signature per size."""
    d = months.select("Sizes", "Slab", "period", F.round(value, 2).alias("value"))
    slabs = F.size(F.collect_set("Slab").over(Window.partitionBy("Sizes")))
    m = Window.partitionBy("Sizes", "period")
    sig = F.transform(F.array_sort(F.collect_list(F.struct(slab_number("Slab").alias("n"), "Slab", "value")).over(m)),
                      lambda e: F.format_string("%.2f", e["value"]))
    return d.withColumns({
        "full_month": F.count("*").over(m) == slabs, "ladder_avg": F.avg("value").over(m), "signature": F.array_join(sig, "|")})


def pick_ladders(history: DataFrame, first_period, horizon: int = 3, anchors=ANCHORS) -> DataFrame:
    """(scenario_id, idx, period, Sizes, Slab, value): for each anchor and plan month the ladder of its
    source month, else the latest complete month.

    Source months are picked on one row per size and month; ladders are then joined in."""
    months = history.groupBy("Sizes", "period").agg(
        F.first("full_month").alias("full_month"), F.first("ladder_avg").alias("a"), F.first("signature").alias("s"))
    full = months.where("full_month")
    by_sig = full.groupBy("Sizes", "s").agg(F.count("*").alias("n"), F.max("period").alias("period"))
    common = by_sig.groupBy("Sizes").agg(F.max_by("period", F.struct("n", "period")).alias("common"))
    picks = full.groupBy("Sizes").agg(
        F.max("period").alias("latest"), F.max_by("period", F.struct("a", "period")).alias("deepest"),
        F.max_by("period", F.struct(-F.col("a"), "period")).alias("shallowest")).join(common, "Sizes")
    first = first_period if isinstance(first_period, Column) else F.lit(first_period).cast("date")
    idx = picks.select("*", first.alias("first_period"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("idx"))
    period = F.add_months("first_period", F.col("idx"))
    wanted = {
        "last_3m_exact": F.add_months("first_period", F.col("idx") - 3), "same_season_last_year": F.add_months(period, -12),
        "most_common_historical_ladder": F.col("common"), "highest_historical_promo_ladder": F.col("deepest"),
        "lowest_historical_promo_ladder": F.col("shallowest"),
    }
    rows = F.array(*[F.struct(F.lit(a).alias("scenario_id"), wanted[a].alias("source")) for a in anchors])
    w = idx.select("Sizes", "idx", period.alias("period"), "latest", F.explode(rows).alias("r")).select(
        "Sizes", "idx", "period", "latest", "r.scenario_id", "r.source")
    known = months.select("Sizes", F.col("period").alias("source"), F.lit(True).alias("known"))
    w = w.join(known, ["Sizes", "source"], "left").withColumn("source", F.when(F.col("known"), F.col("source")).otherwise(F.col("latest")))
    ladders = history.select("Sizes", F.col("period").alias("source"), "Slab", "value")
    return w.join(ladders, ["Sizes", "source"]).select("scenario_id", "idx", "period", "Sizes", "Slab", "value")


def move_ladder(anchor: DataFrame, kind: str = "shift", mode: str = "preserve_gaps", shift_pp: float = 0.0,
                direction: str = "high", pattern: str = "high_base_base") -> DataFrame:
    """Moves anchor ladders: `same_all_3m` repeats the first month, `preserve_gaps` shifts the lowest
    slab and keeps gaps, otherwise every slab shifts. `return_to_normal` shifts one month only."""
    shift = float(shift_pp) * (-1 if direction == "low" else 1)
    factor = F.lit(1.0)
    if kind == "return_to_normal":
        factor = F.when(F.col("idx") == (1 if pattern == "base_high_base" else 0), 1.0).otherwise(0.0)
    first = F.first("value").over(Window.partitionBy("scenario_id", "Sizes", "Slab").orderBy("idx"))
    lowest = F.first("value").over(_by_slab(["scenario_id", "Sizes", "idx"]))
    d = anchor.withColumns({"__first": first, "__low": lowest})
    if kind == "same_all_3m":
        v = F.round(in_range("__first"), 2)
    elif mode == "preserve_gaps":
        target = F.round(in_range(F.col("__low") + F.lit(shift) * factor), 2)
        v = F.round(in_range(target + F.col("value") - F.col("__low")), 2)
    else:
        v = F.round(in_range(F.col("value") + F.lit(shift) * factor), 2)
    return strict_ladder(d.withColumn("value", v).drop("__first", "__low"), ["scenario_id", "Sizes", "idx"])
