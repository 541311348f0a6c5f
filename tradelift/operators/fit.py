"""Demand models. Spark reduces the rows of every group to moments in one aggregation; only moment
rows (one per group, or per group, prefix and penalty) reach numpy."""

from __future__ import annotations

from itertools import product
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tradelift.functions.columns import ratio
from tradelift.functions.lineage import cut
from tradelift.schema import L2_FULL, ModelParams

OTHER = "other_slabs_weighted_base_discount_pct"
CROSS_SIGNS = {"residual_store": 1, "base_discount_pct": 1, "lag1_base_discount_pct": -1, OTHER: -1}
TACTICAL_SIGNS = {"residual_store": 1, "base_discount_pct": 1, "tactical_discount_pct": 1, "lag1_base_discount_pct": -1}
MIN_MONTHS = 3
#: Bounded coefficients up to which a fit tries every set of them.
ENUMERATED = 6


def standardize(cov, cxy, mean):
    """Centred moments of B problems in correlation form: matrix, vector, scales. A column that is flat beside
    its mean has scale 1 and no part in the fit."""
    std = np.sqrt(np.clip(np.einsum("bii->bi", cov), 0.0, None))
    flat = std <= 1e-12 * np.maximum(1.0, np.abs(mean))
    std = np.where(flat, 1.0, std)
    C = np.where(flat[:, :, None] | flat[:, None, :], 0.0, cov / (std[:, :, None] * std[:, None, :]))
    return C, np.where(flat, 0.0, cxy / std), std


def solve_signed(C, c, lam, signs):
    """Minimises w'(C + lam I)w - 2c'w with w_i >= 0, <= 0 or free by signs[i], for B problems.

    Up to `ENUMERATED` bounded coordinates every set of them is tried, beyond that sets are improved step by step. Both end at the
    optimum, which is one point where lam > 0; where lam is 0 and columns depend on each other, at one of the optima."""
    return (_enumerated if np.count_nonzero(signs) <= ENUMERATED else _active)(C, c, lam, signs)


def _on_set(M, c, free, singular):
    """Solutions of the systems restricted to the free coordinates of each problem, zero elsewhere."""
    A, rhs = M * free[:, :, None] * free[:, None, :], c * free
    w = np.empty_like(c)
    if (~singular).any():
        k = ~singular
        w[k] = np.linalg.solve(A[k] + np.eye(c.shape[1]) * (1.0 - free[k])[:, None, :], rhs[k][..., None])[..., 0]
    if singular.any():
        w[singular] = np.einsum("bij,bj->bi", np.linalg.pinv(A[singular], rcond=1e-12, hermitian=True), rhs[singular])
    return w


def _active(C, c, lam, signs):
    """Active sets, all problems side by side: one batched solve a step. A coordinate that would lower the objective most is
    set free; if that drives others past their bound, the step stops at the first bound met and those coordinates are held again. A
    problem ends when no held coordinate would help. The objective falls with every set left, so no set comes twice."""
    sign = np.asarray(signs, dtype=float)
    bounded, turn = sign != 0, np.where(sign < 0, -1.0, 1.0)
    p = len(sign)
    M, c = (C + lam[:, None, None] * np.eye(p)) * turn[:, None] * turn, c * turn
    w, free = np.zeros_like(c), np.repeat((~bounded).astype(float)[None], len(c), axis=0)
    barred, added = np.zeros(c.shape, dtype=bool), np.full(len(c), -1)
    level = 1e-12 * np.maximum(1.0, np.abs(c).max(axis=1, initial=0.0))
    live = np.arange(len(c))
    for _ in range(100 * (p + 1)):
        if not len(live):
            return w * turn
        z = _on_set(M[live], c[live], free[live], lam[live] <= 0)
        past = bounded & (free[live] > 0) & (z <= 0)
        stuck = past.any(axis=1)
        k, zk, over = live[stuck], z[stuck], past[stuck]
        if len(k):
            gap = np.where(over, w[k] - zk, 1.0)
            part = np.where(over, np.where(gap > 0, w[k] / np.where(gap > 0, gap, 1.0), 0.0), np.inf)
            step = part.min(axis=1)
            w[k] += step[:, None] * (zk - w[k])
            leave = over & (part <= step[:, None])
            w[k] = np.where(leave, 0.0, w[k])
            free[k] = np.where(leave, 0.0, free[k])
            # What was freed last and is held again at once gained nothing but rounding: not tried again until the point moves.
            barred[k] = (barred[k] & (step <= 0)[:, None]) | (leave & (np.arange(p) == added[k][:, None]) & (step <= 0)[:, None])
        k = live[~stuck]
        done = np.zeros(len(live), dtype=bool)
        if len(k):
            w[k] = z[~stuck]
            gain = np.where(bounded & (free[k] == 0) & ~barred[k], c[k] - np.einsum("bij,bj->bi", M[k], w[k]), -np.inf)
            top = gain.argmax(axis=1)
            more = gain[np.arange(len(k)), top] > level[k]
            free[k[more], top[more]] = 1.0
            added[k[more]] = top[more]
            done[~stuck] = ~more
        live = live[~done]
    raise ArithmeticError(f"{len(live)} signed regressions did not settle")


def _enumerated(C, c, lam, signs):
    """The optimum solves the free system of some set of coordinates held at zero. Every such set is
    tried at once for all problems and the best result that obeys the signs is taken."""
    B, p = c.shape
    M = C + lam[:, None, None] * np.eye(p)
    sign = np.asarray(signs, dtype=float)
    bounded = [i for i in range(p) if sign[i] != 0]
    best, best_f = np.zeros((B, p)), np.full(B, np.inf)
    singular = lam <= 0
    for held in product([0.0, 1.0], repeat=len(bounded)):
        free = np.ones(p)
        free[bounded] = 1.0 - np.asarray(held)
        w = _on_set(M, c, np.repeat(free[None], B, axis=0), singular)
        f = np.einsum("bi,bij,bj->b", w, M, w) - 2.0 * np.einsum("bi,bi->b", c, w)
        ok = (w * sign >= -1e-10).all(axis=1) & (f < best_f - 1e-13 * np.maximum(1.0, np.abs(best_f, where=np.isfinite(best_f), out=np.ones(B))))
        best[ok], best_f[ok] = w[ok], f[ok]
    return np.where(sign > 0, np.maximum(best, 0.0), np.where(sign < 0, np.minimum(best, 0.0), best))


def _unpack(m: np.ndarray, p: int):
    n, ym, vy = m[:, 0], m[:, 1], np.clip(m[:, 2], 0.0, None)
    mean, cxy = m[:, 3:3 + p], m[:, 3 + p:3 + 2 * p]
    cov = np.zeros((len(m), p, p))
    k = 3 + 2 * p
    for i in range(p):
        for j in range(i, p):
            cov[:, i, j] = cov[:, j, i] = m[:, k]
            k += 1
    return n, ym, vy, mean, cxy, cov


def fit_from_moments(m: np.ndarray, lam: np.ndarray, signs):
    """(intercept, coefficients, r2) for rows of packed moments."""
    n, ym, vy, mean, cxy, cov = _unpack(m, len(signs))
    C, c, std = standardize(cov, cxy, mean)
    w = solve_signed(C, c, lam, signs)
    coef = w / std
    res = vy - 2 * np.einsum("bi,bi->b", c, w) + np.einsum("bi,bij,bj->b", w, C, w)
    live = n * vy > 1e-12 * np.maximum(1.0, ym * ym * 1e-12)
    r2 = np.where(live, 1.0 - np.clip(res, 0.0, None) / np.where(vy > 0, vy, 1.0), 0.0)
    return ym - np.einsum("bi,bi->b", coef, mean), coef, r2


def moment_columns(y: str, xs) -> list[Column]:
    """Aggregates in packing order: count, mean and variance of y, means of x.., covariances with y.., covariances among x.. .
    All are centred by Spark, so a large mean takes nothing from the precision."""
    num = {c: F.col(c).cast("double") for c in [y, *xs]}
    both = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    return [F.sum(F.lit(1.0)), F.avg(num[y]), F.var_pop(num[y]), *[F.avg(num[x]) for x in xs],
            *[F.covar_pop(num[x], num[y]) for x in xs], *[F.covar_pop(num[a], num[b]) for a, b in both]]


def moments(df: DataFrame, keys, y: str, xs) -> DataFrame:
    """One row per group with its packed moments `m`."""
    return df.groupBy(*keys).agg(F.array(*moment_columns(y, xs)).alias("m"))


def fit_moments(packed: DataFrame, keys, xs, signs, ols: bool = True, carry=()) -> DataFrame:
    """Solves every row of (keys, m, lam). Adds n, intercept, r2, coef_<x> and, with `ols`, the plain
    least-squares twin under ols_*. `carry` columns pass through."""
    keys, xs, signs = [*keys, *carry], list(xs), list(signs)
    names = ["n", "intercept", "r2"] + [f"coef_{x}" for x in xs]
    if ols:
        names += ["ols_intercept", "ols_r2"] + [f"ols_coef_{x}" for x in xs]
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField("lam", T.DoubleType())]
                          + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m, lam = np.stack(pdf["m"].to_numpy()).astype(float), pdf["lam"].to_numpy(dtype=float)
            a, b, r2 = fit_from_moments(m, lam, signs)
            out = pdf[keys].reset_index(drop=True)
            cols = [lam, m[:, 0], a, r2, *b.T]
            if ols:
                a0, b0, r0 = fit_from_moments(m, np.zeros(len(m)), [0] * len(xs))
                cols += [a0, r0, *b0.T]
            yield pd.concat([out, pd.DataFrame(dict(zip(["lam", *names], cols)))], axis=1)

    return packed.select(*keys, "m", F.col("lam").cast("double").alias("lam")).mapInPandas(run, schema)


def constrained_ridge(df: DataFrame, keys, y: str, signs: dict[str, int], lam: float = 1.0) -> DataFrame:
    """Sign-constrained ridge per group on standardised features with a free intercept."""
    xs = list(signs)
    return fit_moments(moments(df, keys, y, xs).withColumn("lam", F.lit(max(0.0, float(lam)))), keys, xs, signs.values())


def penalty_scores(df: DataFrame, keys, order, y: str, signs: dict[str, int], candidates) -> DataFrame:
    """Cross-validated R2 per group and penalty: each month from the (p+2)th, or 9th, on is predicted
    from the months before it. Prefix moments make every refit one small solve."""
    keys, xs = list(keys), list(signs)
    p, sg = len(xs), list(signs.values())
    first = max(p + 2, 8)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    pre = df.withColumn("m", F.array(*[c.over(before) for c in moment_columns(y, xs)]))
    pre = pre.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    rows = pre.where((F.get("m", F.lit(0)) >= first) & (F.col("__n") - first >= 3)).select(
        *keys, "m",
        F.array(*[F.col(x).cast("double") for x in xs]).alias("x"), F.col(y).cast("double").alias("y"),
        F.posexplode(F.array(*[F.lit(float(c)) for c in candidates])).alias("idx", "lam"))
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("idx", T.IntegerType()), T.StructField("lam", T.DoubleType()),
        T.StructField("y", T.DoubleType()), T.StructField("err", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m, lam = np.stack(pdf["m"].to_numpy()).astype(float), pdf["lam"].to_numpy(dtype=float)
            a, b, _ = fit_from_moments(m, lam, sg)
            yhat = a + np.einsum("bi,bi->b", b, np.stack(pdf["x"].to_numpy()).astype(float))
            out = pdf[keys + ["idx", "lam", "y"]].copy()
            out["err"] = pdf["y"].to_numpy() - yhat
            yield out

    s = rows.mapInPandas(run, schema).groupBy(*keys, "idx", "lam").agg(
        F.sum(F.col("err") * F.col("err")).alias("ss"), (F.var_pop("y") * F.count("*")).alias("st"))
    return s.select(*keys, "idx", "lam", F.when(F.col("st") > 1e-12, 1.0 - F.col("ss") / F.col("st")).alias("cv_r2"))


def tune_l2(df: DataFrame, keys, order, y: str, signs: dict[str, int], candidates=ModelParams().candidates) -> DataFrame:
    """Best penalty per group; the earlier candidate wins a tie, the first one if no score exists."""
    keys = list(keys)
    s = penalty_scores(df, keys, order, y, signs, candidates)
    best = s.groupBy(*keys).agg(F.max_by(
        F.struct("lam", "cv_r2"), F.struct(F.coalesce("cv_r2", F.lit(float("-inf"))), -F.col("idx"))).alias("b"))
    groups = df.select(*keys).distinct()
    return groups.join(best, keys, "left").select(
        *keys, F.coalesce("b.lam", F.lit(float(candidates[0]))).alias("lam"), F.col("b.cv_r2").alias("cv_r2"))


def tune_train(df: DataFrame, keys, y: str, signs: dict[str, int], candidates=L2_FULL, floor: float = 0.1) -> DataFrame:
    """The penalty (not below `floor`) with the best fit on the training rows."""
    keys, xs = list(keys), list(signs)
    lams = sorted({c for c in candidates if c >= floor} | {floor})
    grid = moments(df, keys, y, xs).select("*", F.explode(F.array(*[F.lit(float(c)) for c in lams])).alias("lam"))
    fits = fit_moments(grid, keys, xs, signs.values(), ols=False)
    return fits.groupBy(*keys).agg(F.max_by("lam", F.struct("r2", -F.col("lam"))).alias("lam"))


def stage1_residual(months: DataFrame, keys, x="actual_discount_pct", y="store_count") -> DataFrame:
    """Outlets regressed on discount per group; adds the fit and each month's residual."""
    w = Window.partitionBy(*keys)
    Y = F.col(y).cast("double")
    d = months.withColumns({
        "stage1_coef_discount": F.coalesce(F.regr_slope(Y, F.col(x)).over(w), F.lit(0.0)),
        "stage1_r2": F.coalesce(F.regr_r2(Y, F.col(x)).over(w), F.lit(0.0)),
        "__ym": F.avg(Y).over(w), "__xm": F.avg(x).over(w)})
    d = d.withColumn("stage1_intercept", F.col("__ym") - F.col("stage1_coef_discount") * F.col("__xm"))
    return d.withColumn(
        "residual_store", Y - F.col("stage1_intercept") - F.col("stage1_coef_discount") * F.col(x)).drop("__ym", "__xm")


def residual_map_join(rows: DataFrame, known: DataFrame, keys, order="period") -> DataFrame:
    """Observed residuals joined by month; a month without one uses the stage-1 fit of its row."""
    k = known.select(*keys, order, F.col("residual_store").alias("observed_residual"))
    fallback = F.col("store_count") - F.col("stage1_intercept") - F.col("stage1_coef_discount") * F.col("actual_discount_pct")
    return rows.join(k, [*keys, order], "left").withColumn(
        "observed_residual", F.coalesce("observed_residual", fallback))


def predict_quantity(coefs, features: dict):
    """intercept + sum(coef * feature); a feature not given counts as zero. `coefs` is the list of
    feature names the row has coef_ columns for."""
    out = F.col("intercept")
    for x in coefs:
        if x in features:
            out = out + F.col(f"coef_{x}") * features[x]
    return out


def _with_enough(months: DataFrame, keys) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return months.withColumn("__n", n).where(F.col("__n") >= MIN_MONTHS).drop("__n")


def fit_two_stage(months: DataFrame, keys, signs: dict[str, int], p: ModelParams, order="period"):
    """(month rows with residuals, coefficient rows). Both fits of all groups run in one plan."""
    keys = list(keys)
    rows = cut(stage1_residual(_with_enough(months, keys), keys))
    xs, carry = list(signs), ["stage1_intercept", "stage1_coef_discount", "stage1_r2", "cv_r2"]
    packed = rows.groupBy(*keys).agg(F.array(*moment_columns("quantity", xs)).alias("m"),
                                     *[F.first(c).alias(c) for c in carry[:3]])
    if p.optimize_l2:
        packed = packed.join(tune_l2(rows, keys, order, "quantity", signs, p.candidates), keys)
    else:
        packed = packed.withColumns({"lam": F.lit(float(p.l2)), "cv_r2": F.lit(None).cast("double")})
    return rows, cut(fit_moments(packed, keys, xs, signs.values(), carry=carry))


def _signs(base: dict[str, int], p: ModelParams) -> dict[str, int]:
    return {k: v for k, v in base.items() if p.include_lag or k != "lag1_base_discount_pct"}


def _money(d: DataFrame, predicted="predicted_quantity", baseline="baseline_quantity") -> DataFrame:
    """Revenue at the actual and the base net price, tactical spend and its one-month ROI."""
    actual = F.col("base_price") * (1 - F.col("actual_discount_pct") / 100.0)
    base = F.col("base_price") * (1 - F.col("base_discount_pct") / 100.0)
    d = d.withColumns({
        "predicted_revenue": F.col(predicted) * actual, "baseline_revenue": F.col(baseline) * base,
        "spend": F.col("base_price") * (F.col("tactical_discount_pct") / 100.0) * F.col(predicted)})
    inc = F.col("predicted_revenue") - F.col("baseline_revenue")
    return d.withColumns({"incremental_revenue": inc, "roi_1mo": F.when(F.col("spend") > 0, inc / F.col("spend"))})


def two_stage_model(months: DataFrame, keys, p: ModelParams = ModelParams(candidates=L2_FULL)):
    """(model rows, coefficients) with the tactical feature."""
    signs = _signs(TACTICAL_SIGNS, p)
    rows, coefs = fit_two_stage(months, keys, signs, p)
    f = {x: F.col(x) for x in signs}
    base_world = {x: c for x, c in f.items() if x != "tactical_discount_pct"}
    d = rows.drop("stage1_intercept", "stage1_coef_discount", "stage1_r2").join(coefs, list(keys)).withColumns({
        "predicted_quantity": predict_quantity(signs, f), "baseline_quantity": predict_quantity(signs, base_world)})
    return _money(d), coefs


def two_stage_cross_slab(months: DataFrame, keys, p: ModelParams = ModelParams()):
    """(model rows, coefficients) with the other slabs' discount instead of the tactical part; penalty
    at least 0.1. Adds the quantity at no discount."""
    signs = _signs(CROSS_SIGNS, p)
    p = ModelParams(**{**p.__dict__, "l2": max(p.l2, 0.1)})
    rows, coefs = fit_two_stage(months, keys, signs, p)
    f = {x: F.col(x) for x in signs}
    d = rows.drop("stage1_intercept", "stage1_coef_discount", "stage1_r2").join(coefs, list(keys)).withColumns({
        "predicted_quantity": predict_quantity(signs, f), "baseline_quantity": predict_quantity(signs, f),
        "non_discount_baseline_quantity": F.greatest(
            predict_quantity(signs, {"residual_store": F.col("residual_store")}), F.lit(0.0))})
    return _money(d), coefs


def prefer_ols(coefs: DataFrame, signs: dict[str, int]) -> DataFrame:
    """Uses the least-squares twin where its signs obey the rules, else the ridge; lists violations."""
    bad = [F.when(F.col(f"ols_coef_{x}") * s < 0, x) for x, s in signs.items() if s]
    d = coefs.withColumn("violations", F.array_join(F.array_compact(F.array(*bad)), ","))
    ok = F.col("violations") == ""
    return d.withColumns(
        {f"used_coef_{x}": F.when(ok, F.col(f"ols_coef_{x}")).otherwise(F.col(f"coef_{x}")) for x in signs}
        | {"used_intercept": F.when(ok, F.col("ols_intercept")).otherwise(F.col("intercept")),
           "model": F.when(ok, "ols").otherwise("ridge")})


def pair_sizes(df: DataFrame, columns, left="12-ML", right="18-ML", keys=(), order="period") -> DataFrame:
    """Two pack series side by side by month, months both have only. One grouped pass, no self join."""
    num = {left: left.split("-")[0], right: right.split("-")[0]}
    aggs = [F.first(F.when(F.col("Sizes") == s, F.col(c)), ignorenulls=True).alias(f"{c}_{n}")
            for s, n in num.items() for c in columns]
    has = [F.count_if(F.col("Sizes") == s).alias(f"__{n}") for s, n in num.items()]
    g = df.where(F.col("Sizes").isin(left, right)).groupBy(*keys, order).agg(*aggs, *has)
    names = [f"__{n}" for n in num.values()]
    return g.where((F.col(names[0]) > 0) & (F.col(names[1]) > 0)).drop(*names)


TWO_PACK_SIGNS = {
    "residual_store_12": 1, "residual_store_18": 1, "base_discount_pct_12": 1, "base_discount_pct_18": 1,
    "lag1_base_discount_pct_12": -1, "lag1_base_discount_pct_18": -1, "mrp_weighted_12": -1, "mrp_weighted_18": -1,
}


def two_pack_model(size_months: DataFrame, signs: dict[str, int] = TWO_PACK_SIGNS, floor: float = 0.1):
    """(model rows, coefficients) of total millilitres on both packs' residual, base, lag and MRP. The coefficients come
    with the sign each feature is held to, and with the number and percent of months whose baseline was clipped at zero."""
    rows = stage1_residual(size_months, ["Sizes"])
    cols = ["quantity", "residual_store", "base_discount_pct", "lag1_base_discount_pct", "mrp_weighted"]
    d = pair_sizes(rows, cols).withColumns({
        "combined_quantity": F.col("quantity_12") + F.col("quantity_18"),
        "combined_volume_ml": F.col("quantity_12") * 12.0 + F.col("quantity_18") * 18.0, "model": F.lit("two_pack")})
    d = cut(d.withColumn("__n", F.count("*").over(Window.partitionBy("model"))).where("__n >= 8").drop("__n"))
    lam = tune_train(d, ["model"], "combined_volume_ml", signs, floor=floor)
    packed = moments(d, ["model"], "combined_volume_ml", list(signs)).join(lam, "model")
    coefs = cut(fit_moments(packed, ["model"], list(signs), signs.values()))
    quiet = {x: F.col(x) for x in signs if not x.startswith(("base_", "lag1_"))}
    m = d.join(coefs, "model").withColumns({
        "predicted_volume_ml": predict_quantity(signs, {x: F.col(x) for x in signs}),
        "raw_baseline_ml": predict_quantity(signs, quiet)})
    m = m.withColumn("non_discount_baseline_ml", F.greatest("raw_baseline_ml", F.lit(0.0))).withColumn(
        "discount_impact_ml", F.col("predicted_volume_ml") - F.col("non_discount_baseline_ml"))
    clips = m.groupBy("model").agg(F.count_if(F.col("raw_baseline_ml") <= 0).alias("baseline_zero_clip_months"), F.count("*").alias("__n"))
    clips = clips.withColumn("baseline_zero_clip_pct", F.col("baseline_zero_clip_months") / F.col("__n") * 100.0).drop("__n")
    held = {f"constraint_{x}": F.lit(">=0" if s > 0 else "<=0" if s < 0 else "none") for x, s in signs.items()}
    return m, coefs.join(clips, "model").withColumns(held)


def ols_inference(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Simple regression per group with R2, adjusted R2, errors, t and F; under three rows nothing."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("xm"), F.avg("y").alias("ym"), F.var_pop("x").alias("vx"),
        F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy")).where("n >= 3")
    n = F.col("n")
    g = g.withColumn("slope", ratio("cxy", "vx", 1.0, 0.0))
    g = g.withColumns({
        "intercept": F.col("ym") - F.col("slope") * F.col("xm"),
        "ss_res": F.greatest(n * (F.col("vy") - F.col("slope") * F.col("cxy")), F.lit(0.0)), "ss_tot": n * F.col("vy")})
    g = g.withColumns({
        "r_squared": F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0),
        "mse": F.col("ss_res") / (n - 2 + F.when(n == 2, 1).otherwise(0))})
    # A flat x has no inverse; its pseudo-inverse spreads the mean over both terms.
    flat = F.col("vx") <= 1e-12
    denom = n * (1 + F.col("xm") * F.col("xm"))
    g = g.withColumns({
        "adj_r_squared": 1 - (1 - F.col("r_squared")) * (n - 1) / (n - 2),
        "se": F.sqrt("mse"),
        "se_slope": F.sqrt(F.when(flat, F.col("mse") * F.col("xm") * F.col("xm") / (denom * (1 + F.col("xm") * F.col("xm"))))
                           .otherwise(F.col("mse") / (n * F.col("vx")))),
        "se_intercept": F.sqrt(F.when(flat, F.col("mse") / (denom * (1 + F.col("xm") * F.col("xm"))))
                               .otherwise(F.col("mse") / n * (1 + F.col("xm") * F.col("xm") / F.col("vx"))))})
    return g.select(
        *keys, "n", "intercept", "slope", "r_squared", "adj_r_squared", "se", "se_intercept", "se_slope",
        F.when(F.col("se_intercept") > 0, F.col("intercept") / F.col("se_intercept")).alias("t_intercept"),
        F.when(F.col("se_slope") > 0, F.col("slope") / F.col("se_slope")).alias("t_slope"),
        F.when(F.col("r_squared") < 1, F.col("r_squared") / ((1 - F.col("r_squared")) / (n - 2))).otherwise(0.0).alias("f_stat"))


def _beta_part(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta for 0 < x <= (a + 1) / (a + b + 2), by its continued fraction run for all
    elements at once until the slowest has settled."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1.0 / safe(1.0 + term * d), safe(1.0 + term / c)
            h *= d * c
        if (np.abs(d * c - 1.0) < 1e-15).all():
            break
    scale = np.frompyfunc(lgamma, 1, 1)
    log = (scale(a + b) - scale(a) - scale(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)
    return np.exp(log) * h / a


def beta_tail(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) of arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1.0, 1.0, 0.0)
    swap = x > (a + 1) / (a + b + 2)
    for own, flip in (((x > 0) & (x < 1) & ~swap, False), ((x > 0) & (x < 1) & swap, True)):
        if own.any():
            part = _beta_part(b[own], a[own], 1.0 - x[own]) if flip else _beta_part(a[own], b[own], x[own])
            out[own] = 1.0 - part if flip else part
    return out


@F.pandas_udf(T.DoubleType())
def two_tailed_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-tailed Student p; also the F(1, dof) tail when t is the root of F."""
    known = (t.notna() & dof.notna() & (dof > 0)).to_numpy()
    v, tt = np.where(known, dof, 1.0).astype(float), np.where(known, t, 0.0).astype(float)
    return pd.Series(np.where(known, beta_tail(v / 2.0, 0.5, v / (v + tt * tt)), np.nan))


def ols_p_values(inference: DataFrame) -> DataFrame:
    dof = (F.col("n") - 2).cast("double")
    return inference.withColumns({
        "p_intercept": two_tailed_p(F.col("t_intercept"), dof), "p_slope": two_tailed_p(F.col("t_slope"), dof),
        "f_pvalue": F.when(F.col("f_stat") > 0, two_tailed_p(F.sqrt("f_stat"), dof)).otherwise(1.0)})
