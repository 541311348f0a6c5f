"""Pack elasticity, trend forecasts and the no-discount baseline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tradelift.functions.columns import clip
from tradelift.operators import sequence as Q
from tradelift.operators.fit import OTHER, pair_sizes


def cross_elasticity(size_months: DataFrame, keys=(), order="period", min_months: int = 6) -> DataFrame:
    """Month-on-month change of each pack regressed on the other's: slopes and R2 both ways. Fewer than
    six usable changes give no row."""
    keys = list(keys)
    p = pair_sizes(size_months.select(*keys, order, "Sizes", "quantity"), ["quantity"], keys=keys, order=order)
    p = p.where("quantity_12 > 0 AND quantity_18 > 0").withColumn("pair", F.lit("12-18"))
    c = Q.pct_change(p, [*keys, "pair"], order, {"quantity_12": "c12", "quantity_18": "c18"}, fill=None)
    g = c.where("c12 IS NOT NULL AND c18 IS NOT NULL").groupBy(*keys, "pair").agg(
        F.count("*").alias("months"), F.regr_slope("c12", "c18").alias("elasticity_12_from_18"),
        F.regr_slope("c18", "c12").alias("elasticity_18_from_12"), F.regr_r2("c12", "c18").alias("r2_12"),
        F.regr_r2("c18", "c12").alias("r2_18"))
    return g.where(F.col("months") >= min_months).drop("pair")


def trend_forecast(df: DataFrame, keys, order, value: str, horizon: int = 3, floor: bool = True) -> DataFrame:
    """Linear trend by row position, `horizon` months on (step 1..horizon). One point repeats itself."""
    keys = list(keys)
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    d = df.withColumn("__i", i)
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(order).alias("last"), F.avg(value).alias("mean"), F.avg("__i").alias("mi"),
        F.coalesce(F.regr_slope(value, "__i"), F.lit(0.0)).alias("slope"))
    f = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))).alias("step"))
    y = F.col("mean") + F.col("slope") * (F.col("n") - 1 + F.col("step") - F.col("mi"))
    return f.select(*keys, "step", F.add_months("last", F.col("step")).alias(order), (clip(y, 0) if floor else y).alias(value))


def holt_forecast(df: DataFrame, keys, order, value: str, horizon: int = 3, floor: bool = True) -> DataFrame:
    """Holt's linear smoothing per month series. For each pair on a grid of smoothing weights the start
    level and trend that fit best are found exactly, because residuals are linear in them. Series
    under four points repeat their last value."""
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("step", T.IntegerType()), T.StructField(value, T.DoubleType())])
    weights = np.stack(np.meshgrid(np.linspace(0.05, 1.0, 20), np.linspace(0.0, 1.0, 21), indexing="ij"), -1).reshape(-1, 2)
    a, b = weights[:, :1], weights[:, 1:]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(dtype=float)
        if len(y) < 4:
            out = np.repeat(y[-1], horizon)
        else:
            # level and trend are affine in (level0, trend0, 1); one row of three for every pair of weights
            level, trend = np.tile([1.0, 0.0, 0.0], (len(weights), 1)), np.tile([0.0, 1.0, 0.0], (len(weights), 1))
            seen = np.empty((len(weights), len(y), 3))
            for i, v in enumerate(y):
                seen[:, i] = level + trend
                new = (1 - a) * seen[:, i] + a * np.array([0.0, 0.0, v])
                level, trend = new, b * (new - level) + (1 - b) * trend
            rest = y - seen[:, :, 2]
            start = np.einsum("gij,gj->gi", np.linalg.pinv(seen[:, :, :2], rcond=len(y) * np.finfo(float).eps), rest)
            sse = ((rest - np.einsum("gij,gj->gi", seen[:, :, :2], start)) ** 2).sum(1)
            k = int(np.flatnonzero(sse <= sse.min() + 1e-12)[0])
            state = np.append(start[k], 1.0)
            out = level[k] @ state + trend[k] @ state * np.arange(1, horizon + 1)
        out = np.clip(out, 0.0, None) if floor else out
        res = pd.DataFrame({"step": np.arange(1, horizon + 1, dtype=np.int32), value: out})
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "step", value]]

    last = df.groupBy(*keys).agg(F.max(order).alias("__last"))
    series = df.select(*keys, order, F.col(value).cast("double").alias(value))
    return series.groupBy(*keys).applyInPandas(run, schema).join(last, keys).select(
        *keys, "step", F.add_months("__last", F.col("step")).alias(order), value)


def month_spine(df: DataFrame, keys, columns, order="period") -> DataFrame:
    """Every month seen in any series, for every series; missing values are 0. The months, which a calendar bounds, are one
    array that every series explodes."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    months = df.agg(F.collect_set(order)).scalar()
    spine = df.select(*keys).distinct().select(*keys, F.explode(months).alias(order))
    return spine.join(df.select(*keys, order, *columns), [*keys, order], "left").fillna(0.0, list(columns))


def pack_history(model_rows: DataFrame, keys=("Sizes",), order="period") -> DataFrame:
    """No-discount baseline and discount component summed over slabs."""
    b, lag, oth = (F.coalesce(F.col(f"coef_{c}"), F.lit(0.0)) * F.coalesce(c, F.lit(0.0))
                   for c in ("base_discount_pct", "lag1_base_discount_pct", OTHER))
    return model_rows.withColumn("__d", b + lag + oth).groupBy(*keys, order).agg(
        F.sum("non_discount_baseline_quantity").alias("baseline_quantity"), F.sum("__d").alias("discount_component"))


def baseline_forecast(model_rows: DataFrame, horizon: int = 3, method: str = "trend", order="period") -> DataFrame:
    """History plus `horizon` months per pack; the discount component repeats its last months."""
    hist = month_spine(pack_history(model_rows), "Sizes", ["baseline_quantity", "discount_component"], order)
    ahead = (holt_forecast if method == "holt" else trend_forecast)(hist, ["Sizes"], order, "baseline_quantity", horizon)
    carried = Q.trailing_series(hist, ["Sizes"], order, "discount_component", horizon).select(
        "Sizes", (F.col("idx") + 1).alias("step"), "discount_component")
    future = ahead.join(carried, ["Sizes", "step"]).select(
        "Sizes", order, "baseline_quantity", "discount_component", F.lit(True).alias("is_forecast"))
    out = hist.withColumn("is_forecast", F.lit(False)).unionByName(future)
    return out.withColumn("total_baseline", F.sum("baseline_quantity").over(Window.partitionBy(order)))


def baseline_decomposition(history: DataFrame, actual: DataFrame, order="period") -> DataFrame:
    """History split into baseline and discount volume inside the actual volume (the modelled total
    where no actual volume is known)."""
    j = history.join(actual.select("Sizes", order, F.col("volume").alias("__v")), ["Sizes", order], "left")
    whole = F.when(F.col("__v") > 0, F.col("__v")).otherwise(F.col("baseline_quantity") + F.col("discount_component"))
    base = F.least(F.greatest("baseline_quantity", F.lit(0.0)), whole)
    return j.select("Sizes", order, whole.alias("total_volume"), base.alias("baseline_volume"),
                    F.greatest(whole - base, F.lit(0.0)).alias("discount_volume"))


def slab_baseline_projection(model_rows: DataFrame, order="period") -> DataFrame:
    """No-discount baseline per slab, pack and in total in one rollup."""
    q = model_rows.groupingSets(
        [[order, "Sizes", "Slab"], [order, "Sizes"], [order]], order, "Sizes", "Slab").agg(
        F.sum("non_discount_baseline_quantity").alias("baseline_quantity"))
    return q.fillna("TOTAL", ["Sizes"]).fillna("ALL", ["Slab"])


def cross_adjusted_forecast(forecast: DataFrame, elasticity: DataFrame, order="period") -> DataFrame:
    """Forecast months of both packs moved by the other's change times the cross elasticity."""
    p = pair_sizes(forecast, ["baseline_quantity", "is_forecast"], order=order).withColumn("pair", F.lit("12-18"))
    p = Q.pct_change(p, ["pair"], order, {"baseline_quantity_12": "raw_change_pct_12", "baseline_quantity_18": "raw_change_pct_18"})
    e = elasticity.agg(F.struct(F.max("elasticity_12_from_18").alias("a"), F.max("elasticity_18_from_12").alias("b"))).scalar()

    def moved(own, other, k):
        base = F.greatest(F.col(own), F.lit(0.0))
        return F.greatest(F.when(F.col("is_forecast_12"), base * (1 + F.coalesce(k, F.lit(0.0)) * F.col(other) / 100.0)).otherwise(base), F.lit(0.0))

    p = p.withColumns({
        "baseline_12_adjusted": moved("baseline_quantity_12", "raw_change_pct_18", e["a"]),
        "baseline_18_adjusted": moved("baseline_quantity_18", "raw_change_pct_12", e["b"])})
    return p.withColumn("baseline_total_adjusted", F.col("baseline_12_adjusted") + F.col("baseline_18_adjusted")).withColumnRenamed(
        "is_forecast_12", "is_forecast").drop("is_forecast_18", "pair")
