"""Which rows take part: filters, outlet sets, slab assignment and the option lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.functions.columns import allowed_slab, month_of, norm_size, outlet_group
from tradelift.schema import Filters, SlabRules

_FILTER_COLUMNS = [
    ("states", "Final_State"), ("categories", "Category"), ("subcategories", "Subcategory"),
    ("brands", "Brand"), ("sizes", "Sizes"),
]


def group_labels(values) -> list[str]:
    """Class texts to the two outlet groups, each once, OtherGT first."""
    out = {"WH" if v.upper().replace(" ", "") == "WH" else "OtherGT" for v in values if v and v.strip()}
    return sorted(out)


def base_filters(df: DataFrame, f: Filters) -> DataFrame:
    for attr, c in _FILTER_COLUMNS:
        values = getattr(f, attr)
        if values:
            df = df.where(F.col(c).isin(*values))
    groups = group_labels(f.outlet_classifications)
    if groups:
        df = df.where(outlet_group("Final_Outlet_Classification").isin(*groups))
    return df


def eda_scope(df: DataFrame, f: Filters, product_codes=()) -> DataFrame:
    out = base_filters(df, f)
    return out.where(F.col("Sku_Code").isin(*product_codes)) if product_codes else out


def with_outlet_group(df: DataFrame) -> DataFrame:
    return df.withColumn("Outlet_Group", outlet_group("Final_Outlet_Classification"))


def valid_rows(df: DataFrame, measure: str, channel: str | None = "GT", states=()) -> DataFrame:
    ok = F.col("Date").isNotNull() & (F.col("Quantity") > 0) & F.col(measure).isNotNull()
    if channel:
        ok = ok & (F.upper(F.trim("Outlet_Type")) == channel.upper())
    if states:
        ok = ok & F.col("Final_State").isin(*[s.strip().upper() for s in states])
    return df.where(ok)


def drop_slab0(df: DataFrame) -> DataFrame:
    return df.where(F.col("Slab") != "slab0")


def semi_outlets(df: DataFrame, outlets: DataFrame) -> DataFrame:
    return df.join(outlets.select("Outlet_ID"), "Outlet_ID", "left_semi")


def outlet_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("Outlet_ID").intersect(right.select("Outlet_ID"))


def distinct_rows(df: DataFrame, keys, last_by: str | None = None) -> DataFrame:
    """One row per key; with `last_by` the row that is latest in that column (ties: largest row)."""
    if last_by is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(F.col(last_by).alias("__by"), *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max(row).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def grain_totals(df: DataFrame) -> DataFrame:
    """Month quantity per outlet and size."""
    return df.groupBy("Outlet_ID", month_of("Date").alias("Month"), "Sizes").agg(
        F.sum(F.coalesce("Quantity", F.lit(0.0))).alias("Monthly_Quantity"))


def grain_back_join(df: DataFrame) -> DataFrame:
    """Each row with its outlet-month-size quantity, null for a row without outlet, date or size. The totals are
    combined map-side and joined back, so that one outlet with very many rows is split by the skew join instead
    of landing in one window partition."""
    return df.withColumn("Month", month_of("Date")).join(grain_totals(df), ["Outlet_ID", "Month", "Sizes"], "left")


def repair_thresholds(thresholds, slab_count: int) -> list[float]:
    """Finite, distinct, rising and slab_count - 1 long; gaps are filled from the defaults."""
    want = max(1, max(2, min(20, int(slab_count))) - 1)
    got = []
    for t in thresholds or ():
        try:
            v = float(t)
        except (TypeError, ValueError):
            continue
        if math.isfinite(v):
            got.append(v)
    seed = list(SlabRules().thresholds)

    def stretch(xs):
        while len(xs) < want:
            last = xs[-1] if xs else 1.0
            xs.append(last + max(1.0, abs(last) * 0.1))
        return xs

    got = sorted(set(got)) or seed[:want]
    if len(got) < want:
        got = stretch(sorted(set((got + stretch(seed))[:want])))
    return got[:want]


def slab_ladder(quantity, thresholds) -> Column:
    """`[a, b)` bins named slab0, slab1, ..."""
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    out = F.lit(f"slab{len(thresholds)}")
    for i in range(len(thresholds) - 1, -1, -1):
        out = F.when(q < thresholds[i], f"slab{i}").otherwise(out)
    return F.when(q.isNull(), "slab0").otherwise(out)


def slab_of(size, quantity, rules: SlabRules) -> Column:
    s = norm_size(size)
    out = slab_ladder(quantity, list(rules.thresholds))
    for k, t in rules.per_size.items():
        out = F.when(s == k, slab_ladder(quantity, list(t) or list(rules.thresholds))).otherwise(out)
    return out


def assign_slabs(df: DataFrame, rules: SlabRules) -> DataFrame:
    """Rows with Slab recomputed from the outlet's month quantity (mode "define"); slab0 where that is unknown."""
    if rules.mode != "define":
        return df
    return grain_back_join(df).withColumn("Slab", slab_of("Sizes", "Monthly_Quantity", rules)).drop(
        "Month", "Monthly_Quantity")


def outlet_days(df: DataFrame, rules: SlabRules, keys=()) -> DataFrame:
    """Sums per outlet, size, slab and day, the input of every day and month table.

    In mode "define" rows first shrink to one per outlet, size and day; the outlet's month
    quantity is then a window over at most 31 of those, whatever the outlet's size."""
    measures = [c for c in ("Quantity", "scheme_amount", "dsp_sales", "clp_sales", "SalesValue_atBasicRate",
                            "TotalDiscount", "mrp_qty", "scheme_qty", "qps_qty", "rows") if c in df.columns]
    sums = [F.sum(c).alias(c) for c in measures]
    if rules.mode != "define":
        return df.groupBy(*keys, "Outlet_ID", "Sizes", "Slab", "Date").agg(*sums)
    days = df.groupBy(*keys, "Outlet_ID", "Sizes", "Date").agg(*sums)
    # With extra keys an outlet's month spans them, so the slab still comes from the whole outlet.
    w = Window.partitionBy("Outlet_ID", "Sizes", month_of("Date"))
    return days.withColumn("Slab", slab_of("Sizes", F.sum("Quantity").over(w), rules))


def outlet_months(df: DataFrame, rules: SlabRules, measures=("Quantity", "SalesValue_atBasicRate", "TotalDiscount")) -> DataFrame:
    """Sums, rows and distinct invoices per outlet, size, slab and month. Rows shrink to one per invoice first, so the
    invoices are counted without copying rows and an outlet with very many of them is spread; rows without an invoice
    number count as rows only. In mode "define" the slab follows from the month's own quantity."""
    grain = ["Outlet_ID", "Sizes", "Month"] + ([] if rules.mode == "define" else ["Slab"])
    bills = df.withColumn("Month", month_of("Date")).groupBy(*grain, "Bill_No").agg(
        *[F.sum(c).alias(c) for c in measures], F.count("*").alias("rows"))
    months = bills.groupBy(*grain).agg(
        *[F.sum(c).alias(c) for c in measures], F.sum("rows").alias("rows"), F.count("Bill_No").alias("invoices"))
    if rules.mode != "define":
        return months
    known = F.col("Outlet_ID").isNotNull() & F.col("Month").isNotNull()
    return months.withColumn("Slab", slab_of("Sizes", F.when(known, F.coalesce("Quantity", F.lit(0.0))), rules))


def step_scope(txn: DataFrame, rfm: DataFrame, segments=(), outlet_classes=(), outlet_ids=(), slabs=(),
               rules: SlabRules = SlabRules()) -> tuple[DataFrame, DataFrame]:
    """(scope, scope over all slabs). A class choice keeps outlets having any row of that class."""
    chosen = rfm
    if segments:
        chosen = chosen.where(F.col("RFM_Segment").isin(*segments))
    if outlet_ids:
        chosen = chosen.where(F.col("Outlet_ID").isin(*[str(o) for o in outlet_ids]))
    scoped = semi_outlets(txn, chosen)
    groups = group_labels(outlet_classes)
    if groups:
        scoped = semi_outlets(scoped, txn.where(outlet_group("Final_Outlet_Classification").isin(*groups)))
    every_slab = assign_slabs(scoped, rules)
    kept = every_slab.where(allowed_slab("Slab"))
    if slabs:
        kept = kept.where(F.col("Slab").isin(*slabs))
    return kept, every_slab


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct values of the six filter dimensions in one pass over the fact."""
    dims = {"states": F.col("Final_State"), "categories": F.col("Category"), "subcategories": F.col("Subcategory"),
            "brands": F.col("Brand"), "sizes": F.col("Sizes"),
            "outlet_classifications": outlet_group("Final_Outlet_Classification")}
    return _long_distinct(df, {k: (F.lit(True), v) for k, v in dims.items()})


def _long_distinct(df: DataFrame, parts: dict) -> DataFrame:
    """One pass: every row yields its (option, value) pairs where the option's condition holds.
    Combining map-side leaves only distinct pairs to shuffle."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("option"), F.when(cond, v.cast("string")).alias("value")) for k, (cond, v) in parts.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.option", "p.value").where(
        "value IS NOT NULL AND value <> ''").distinct()


def cascading_options(df: DataFrame, f: Filters) -> DataFrame:
    """Option lists in which each level is narrowed by its parents only."""
    conds, ok = {}, F.lit(True)
    for attr, c in _FILTER_COLUMNS:
        conds[attr] = (ok, F.col(c))
        if getattr(f, attr):
            ok = ok & F.col(c).isin(*getattr(f, attr))
    conds["outlet_classifications"] = (ok, outlet_group("Final_Outlet_Classification"))
    return _long_distinct(df, conds)


def outlet_profile(txn: DataFrame, rules: SlabRules, outlet_classes=()) -> DataFrame:
    """One row per outlet from one pass over the fact: its classes, its slabs, and the slabs of its rows of the chosen
    classes taken alone (all rows without a choice). The sets are as short as the lists of classes and slabs."""
    group, choice = outlet_group("Final_Outlet_Classification"), group_labels(outlet_classes)
    chosen = group.isin(*choice) if choice else F.lit(True)
    if rules.mode == "define":
        q = F.coalesce("Quantity", F.lit(0.0))
        grains = txn.groupBy("Outlet_ID", "Sizes", month_of("Date").alias("Month")).agg(
            F.sum(q).alias("q"), F.sum(F.when(chosen, q)).alias("chosen_q"), F.max(chosen).alias("has"), F.collect_set(group).alias("groups"))
        known = F.col("Month").isNotNull() & F.col("Sizes").isNotNull()
        slab = slab_of("Sizes", F.when(known, F.col("q")), rules)
        chosen_slab = F.when(F.col("has"), slab_of("Sizes", F.when(known, F.col("chosen_q")), rules))
    else:
        grains = txn.groupBy("Outlet_ID", "Slab", group.alias("group")).agg(F.max(chosen).alias("has")).withColumn("groups", F.array("group"))
        slab, chosen_slab = F.col("Slab"), F.when(F.col("has"), F.col("Slab"))
    return grains.where("Outlet_ID IS NOT NULL").groupBy("Outlet_ID").agg(
        F.array_distinct(F.flatten(F.collect_set("groups"))).alias("groups"), F.collect_set(slab).alias("slabs"),
        F.collect_set(chosen_slab).alias("chosen_slabs"))


def discount_options(txn: DataFrame, rfm: DataFrame, segments=(), outlet_classes=(), slabs=(),
                     rules: SlabRules = SlabRules()) -> DataFrame:
    """Segments (all), classes under the segments, slabs under segments and classes, and the number
    of outlets the full choice matches. All four come from the outlets' profiles, so the fact is read once."""
    d = rfm.select("Outlet_ID", "RFM_Segment").join(outlet_profile(txn, rules, outlet_classes), "Outlet_ID", "left")
    inside = F.col("groups").isNotNull()
    if segments:
        inside = inside & F.coalesce(F.col("RFM_Segment").isin(*segments), F.lit(False))
    groups, match = group_labels(outlet_classes), F.filter("slabs", lambda s: allowed_slab(s))
    if slabs:
        match = F.filter(match, lambda s: s.isin(*slabs))
    match = inside & (F.size(match) > 0)
    if groups:
        match = match & F.arrays_overlap("groups", F.array(*[F.lit(g) for g in groups]))

    def pairs(option, values):
        return F.transform(values, lambda v: F.struct(F.lit(option).alias("option"), v.cast("string").alias("value")))

    none = F.array().cast("array<string>")
    listed = F.concat(
        pairs("rfm_segments", F.array("RFM_Segment")), pairs("outlet_classifications", F.when(inside, F.col("groups")).otherwise(none)),
        pairs("slabs", F.when(inside, F.filter("chosen_slabs", lambda s: allowed_slab(s))).otherwise(none)),
        pairs("matching_outlets", F.when(match, F.array(F.lit("1"))).otherwise(none)))
    found = d.select(F.explode(listed).alias("p")).select("p.option", "p.value").where("value IS NOT NULL AND value <> ''")
    counted = found.withColumn("outlets", F.lit(1)).unionByName(
        txn.sparkSession.range(1).select(F.lit("matching_outlets").alias("option"), F.lit("1").alias("value"), F.lit(0).alias("outlets")))
    return counted.groupBy("option", "value").agg(F.sum("outlets").alias("outlets")).select(
        "option", F.when(F.col("option") == "matching_outlets", F.col("outlets").cast("string")).otherwise(F.col("value")).alias("value"))
