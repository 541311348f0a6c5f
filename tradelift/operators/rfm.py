"""Outlet segmentation: recency, frequency, monetary labels and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradelift.functions.columns import positive_ratio, total
from tradelift.functions.lineage import cut
from tradelift.operators import ranking, sketches
from tradelift.schema import SEGMENTS, RfmParams

ORDER_KEYS = ["Outlet_ID", "Date", "Bill_No", "Final_State"]

# The nine sort keys an outlet listing accepts.
SORT_KEYS = {
    "outlet_id": "Outlet_ID", "final_state": "Final_State", "rfm_segment": "RFM_Segment",
    "total_net_amt": "Total_Net_Amt", "orders_count": "orders_count", "aov": "AOV",
    "recency_days": "Recency_days", "unique_order_days": "unique_order_days",
    "orders_per_day": "orders_per_day",
}


def order_level(txn: DataFrame) -> DataFrame:
    """One row per outlet, day, bill and state; rows with a missing key are left out."""
    keyed = txn.dropna(subset=ORDER_KEYS)
    return keyed.groupBy(*ORDER_KEYS).agg(
        F.sum("Quantity").alias("Quantity"), F.sum("Net_Amt").alias("Net_Amt")
    )


def _outlet_level(txn: DataFrame, lg_k: int | None = None) -> DataFrame:
    """One pass over the fact: order statistics and plain totals per outlet and state. With `lg_k` the order days
    are an estimate by a sketch."""
    orders = txn.groupBy(*ORDER_KEYS).agg(
        F.sum("Net_Amt").alias("net"), F.sum("SalesValue_atBasicRate").alias("sales")
    )
    whole = F.col("Date").isNotNull() & F.col("Bill_No").isNotNull() & F.col("Final_State").isNotNull()
    day, net = F.when(whole, F.col("Date")), F.when(whole, F.col("net"))
    return orders.groupBy("Outlet_ID", "Final_State").agg(
        F.min(day).alias("first_order"),
        F.max(day).alias("last_order"),
        (F.count_distinct(day) if lg_k is None else sketches.estimate(F.datediff(day, F.lit("1970-01-01")), lg_k)).alias("unique_order_days"),
        F.count(day).alias("orders_count"),
        F.avg(net).alias("AOV"),
        F.max("Date").alias("any_last"),
        F.sum("net").alias("state_net"),
        F.sum("sales").alias("state_sales"),
    )


#: Cells of the log scale per unit, as a power of two, and bits of a cell's number inside its block.
CELL_BITS, BLOCK_BITS = 20, 10


def _scored(df: DataFrame) -> DataFrame:
    """Adds the means on both sides of a cut after (ln, ls) of (tn, ts), and the part of the variance between them, times tn squared."""
    rn = F.col("tn") - F.col("ln")
    return df.withColumns({"lm": F.col("ls") / F.col("ln"), "rm": F.when(rn > 0, (F.col("ts") - F.col("ls")) / rn)}).withColumn(
        "between", F.col("ln") * rn * F.pow(F.col("rm") - F.col("lm"), F.lit(2.0)))


def monetary_cut(outlets: DataFrame, value: str = "AOV") -> DataFrame:
    """One row (n, threshold, median) that splits log1p(value) into two clusters.

    In one dimension the best two clusters are the two sides of one cut, so every cut is scored
    from prefix counts and sums. Outlets first collapse into cells 2^-20 wide on the log scale, cells are cumulated inside
    blocks 2^-10 wide, and blocks in one window. Cells and blocks are bounded by the value range, not by
    the number of outlets: a block has at most 1,024 cells and there are some ten thousand blocks.
    Cuts inside a cell are scored too wherever they could beat the best cut between cells: from a cell's ends follows a bound on
    what its inner cuts can reach, and only cells that pass it are opened, value by value. Equal values always stay
    together; of cuts alike in score the lowest is taken. The threshold lies halfway between the cluster means, where
    nearest-centre assignment changes. The median counts below ten outlets only and is null otherwise.
    """
    x = F.coalesce(F.log1p(F.when(F.col(value) > -1, F.col(value))), F.lit(-1.0))
    known = outlets.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), x.alias("x")).withColumn("cell", F.floor(F.col("x") * (1 << CELL_BITS)))
    cells = known.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("block", F.shiftright("cell", BLOCK_BITS))
    blocks = cells.groupBy("block").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = Window.partitionBy(F.lit(1))
    prior = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("bn"),
        F.coalesce(F.sum("s").over(prior), F.lit(0.0)).alias("bs"),
        F.sum("n").over(every).alias("tn"), F.sum("s").over(every).alias("ts"),
    )
    inside = Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = cut(_scored(cells.join(blocks, "block").withColumns({
        "ln": F.sum("n").over(inside) + F.col("bn"), "ls": F.sum("s").over(inside) + F.col("bs")})))
    best = ends.agg(F.coalesce(F.max("between"), F.lit(0.0))).scalar()
    # With D = ls - ln * mean a cut scores (D * tn)^2 / (ln * rn). Inside a cell D moves from one end's to the other's, turning at most
    # once, by less than the cell's width for each row; ln * rn is least at an end.
    off = lambda ln, ls: F.abs(ls - ln * F.col("ts") / F.col("tn"))
    ln0, ls0 = F.col("ln") - F.col("n"), F.col("ls") - F.col("s")
    reach = F.greatest(off(F.col("ln"), F.col("ls")), off(ln0, ls0)) + F.col("n") * 2.0 ** -CELL_BITS
    weight = F.least((ln0 + 1) * (F.col("tn") - ln0 - 1), (F.col("ln") - 1) * (F.col("tn") - F.col("ln") + 1))
    bound = F.pow(reach * F.col("tn"), F.lit(2.0)) / F.greatest(weight, F.lit(1))
    open_cells = ends.where((F.col("lo") < F.col("hi")) & (bound >= best)).select("cell", ln0.alias("n0"), ls0.alias("s0"), "tn", "ts")
    values = known.join(open_cells, "cell").groupBy("cell", "x").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n0", "s0", "tn", "ts")])
    upto = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inner = _scored(values.withColumns({
        "ln": F.sum("n").over(upto) + F.col("n0"), "ls": F.sum(F.col("x") * F.col("n")).over(upto) + F.col("s0")}))
    taken = ["tn", "lm", "rm", "between"]
    few = known.limit(10).agg(F.percentile("v", F.lit(0.5))).scalar()
    out = ends.select(*taken, F.col("hi").alias("x")).unionByName(inner.select(*taken, "x")).agg(
        F.max("tn").alias("n"), F.max_by((F.col("lm") + F.col("rm")) / 2, F.struct("between", -F.col("x"))).alias("threshold"))
    return out.withColumn("median", F.when(F.col("n") < 10, few))


def monetary_split(outlets: DataFrame) -> DataFrame:
    """Adds M_label and M_cluster_id. Under ten valued outlets the median decides."""
    split = monetary_cut(outlets).select(F.struct("n", "threshold", "median").alias("split")).scalar()
    aov = F.col("AOV")
    clustered = F.coalesce(split["n"], F.lit(0)) >= 10
    # A value at or below -1 has no logarithm and stays on the low side.
    x = F.log1p(F.when(aov > -1, aov))
    high = F.when(clustered, F.coalesce(x > split["threshold"], F.lit(False))).otherwise(aov >= split["median"])
    return outlets.withColumn(
        "M_label", F.when(aov.isNull(), None).when(high, "High").otherwise("Low")
    ).withColumn(
        "M_cluster_id", F.when(clustered & aov.isNotNull(), F.when(F.col("M_label") == "High", 1.0).otherwise(0.0))
    )


def rfm_segment(rfm: DataFrame) -> DataFrame:
    return rfm.withColumn(
        "RFM_Segment",
        F.concat(F.col("R_label"), F.lit("-"), F.col("F_label"), F.lit("-"), F.col("M_label")),
    )


def recency_frequency(txn: DataFrame, params: RfmParams = RfmParams()) -> DataFrame:
    """Outlet and state rows with order statistics, recency and frequency labels and totals.

    Total_Net_Amt and Total_Sales are the outlet's totals over all its states, Scope_Sales the whole
    scope's."""
    # The fact is read once: everything below works on one row per outlet and state.
    level = cut(_outlet_level(txn, params.sketch_bits))
    scope = level.agg(F.struct(F.max("any_last").alias("newest"), F.sum("state_sales").alias("sales"))).scalar()
    outlet = Window.partitionBy("Outlet_ID")
    recency = F.datediff(scope["newest"], F.col("last_order"))
    active = F.greatest(F.datediff("last_order", "first_order") + 1, F.lit(1))
    high_f = F.col("unique_order_days") >= params.frequency_threshold
    totals = level.where(F.col("Outlet_ID").isNotNull()).withColumns({
        "Total_Net_Amt": F.sum("state_net").over(outlet), "Total_Sales": F.sum("state_sales").over(outlet)})
    return totals.where(F.col("orders_count") > 0).select(
        "Outlet_ID", "Final_State", "first_order", "last_order", "unique_order_days", "orders_count", "AOV", "Total_Net_Amt", "Total_Sales",
        scope["sales"].alias("Scope_Sales"), recency.alias("Recency_days"),
        (recency <= params.recency_days).cast("int").alias("Recency_flag"),
        F.when(recency <= params.recency_days, "Recent").otherwise("Stale").alias("R_label"),
        active.alias("active_days"), (F.col("orders_count") / active).alias("orders_per_day"),
        F.when(high_f, "High").otherwise("Low").alias("F_label"), high_f.cast("int").alias("F_cluster_id"))


def rfm_outlets(txn: DataFrame, params: RfmParams = RfmParams()) -> DataFrame:
    return rfm_segment(monetary_split(recency_frequency(txn, params)))


def join_outlet_totals(outlets: DataFrame, txn: DataFrame, how: str = "left") -> DataFrame:
    """Adds Total_Net_Amt to any outlet table; `how` is "left" or "inner"."""
    totals = txn.groupBy("Outlet_ID").agg(F.sum("Net_Amt").alias("Total_Net_Amt"))
    return outlets.join(totals, "Outlet_ID", how)


def segment_spine(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in SEGMENTS])).alias("segment"))


def segment_summary(rfm: DataFrame, states=("MAH", "UP")) -> DataFrame:
    """The eight segments with outlet counts, means and share of all sales.

    An outlet's sales count once in each segment it appears in."""
    per_outlet = rfm.groupBy(F.col("RFM_Segment").alias("segment"), "Outlet_ID").agg(
        F.count("*").alias("rows"),
        F.max("Total_Sales").alias("sales"), F.max("Scope_Sales").alias("scope"),
        F.sum("unique_order_days").alias("days"),
        F.sum("AOV").alias("aov"),
        F.sum("Recency_days").alias("recency"),
        *[F.count_if(F.col("Final_State") == s).alias(f"s{i}") for i, s in enumerate(states)],
    )
    grouped = per_outlet.groupBy("segment").agg(
        F.sum("rows").alias("total_outlets"),
        F.sum("sales").alias("seg_sales"), F.max("scope").alias("scope"),
        (F.sum("days") / F.sum("rows")).alias("avg_order_days"),
        (F.sum("aov") / F.sum("rows")).alias("avg_aov"),
        (F.sum("recency") / F.sum("rows")).alias("avg_recency"),
        *[F.sum(f"s{i}").alias(f"{s.lower()}_count") for i, s in enumerate(states)],
    )
    filled = segment_spine(rfm.sparkSession).join(grouped, "segment", "left").fillna(0)
    return filled.select(
        "segment",
        "total_outlets",
        F.round(positive_ratio("total_outlets", total("total_outlets"), 100.0, 0.0), 2).alias("percentage"),
        *[f"{s.lower()}_count" for s in states],
        F.round("avg_order_days", 2).alias("avg_order_days"),
        F.round("avg_aov", 2).alias("avg_aov"),
        F.round("avg_recency", 2).alias("avg_recency"),
        F.round(positive_ratio("seg_sales", "scope", 100.0, 0.0), 2).alias("market_share"),
    )


def cluster_summary(rfm: DataFrame) -> DataFrame:
    """Range of orders per day by frequency label and of order value by monetary label."""

    def ranges(kind, label, value):
        return rfm.groupBy(F.col(label).alias("cluster")).agg(
            F.count(value).alias("outlets"), F.min(value).alias("min_value"),
            F.max(value).alias("max_value"), F.avg(value).alias("mean_value"),
        ).select(F.lit(kind).alias("kind"), "cluster", "outlets", "min_value", "max_value", "mean_value")

    return ranges("frequency", "F_label", "orders_per_day").unionByName(ranges("monetary", "M_label", "AOV"))


def segment_kpis(rfm: DataFrame) -> DataFrame:
    """Shares of recent, frequent and high-value outlets and outlet-weighted means, in one pass."""
    seg = F.col("RFM_Segment")
    n = F.count("*")

    def share(cond):
        return F.coalesce(F.when(n > 0, F.count_if(cond) / n * 100.0), F.lit(0.0))

    return rfm.agg(
        n.alias("total_outlets"),
        share(seg.startswith("Recent-")).alias("recent_pct"),
        share(seg.contains("-High-")).alias("high_frequency_pct"),
        share(seg.endswith("-High")).alias("high_monetary_pct"),
        F.coalesce(F.avg("AOV"), F.lit(0.0)).alias("avg_aov"),
        F.coalesce(F.avg("unique_order_days"), F.lit(0.0)).alias("avg_order_days"),
        F.coalesce(F.avg("orders_per_day"), F.lit(0.0)).alias("avg_orders_per_day"),
    )


def outlet_search(rfm: DataFrame, term: str) -> DataFrame:
    """Case-blind literal substring over outlet id, state or segment."""
    t = (term or "").strip().lower()
    if not t:
        return rfm
    hit = F.lit(False)
    for c in ("Outlet_ID", "Final_State", "RFM_Segment"):
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return rfm.where(hit)


def _order(sort_key: str, descending: bool):
    c = SORT_KEYS.get((sort_key or "").lower(), "Total_Net_Amt")
    return [(c, descending, True), ("Outlet_ID", False, False), ("Final_State", False, False)]


def _ordering(sort_key: str, descending: bool):
    return ranking.sort_columns(_order(sort_key, descending))


def sort_page(rfm: DataFrame, sort_key="total_net_amt", descending=True, page=1, page_size=20) -> DataFrame:
    """One page of the listing; the page number is clamped to the last page.

    The listing is computed once and counted; the page is found by order statistics (`ranking.page`), so a page deep in
    a long listing sorts and moves about the rows of the page."""
    size = max(1, int(page_size))
    rfm = cut(rfm)
    n = rfm.count()
    pages = max(1, -(-n // size))
    number = min(max(1, int(page)), pages)
    return (
        ranking.page(rfm, _order(sort_key, descending), (number - 1) * size, size, n)
        .withColumn("total_rows", F.lit(n)).withColumn("total_pages", F.lit(pages))
        .withColumn("page", F.lit(number))
    )


def export_outlets(rfm: DataFrame, term: str = "", sort_key="total_net_amt", descending=True) -> DataFrame:
    """The whole listing under its export headings, ordered for writing."""
    return outlet_search(rfm, term).orderBy(*_ordering(sort_key, descending)).select(
        "Outlet_ID", F.col("Final_State").alias("State"), "RFM_Segment", "Total_Net_Amt",
        F.col("orders_count").alias("Orders"), "AOV", F.col("Recency_days").alias("Recency_Days"),
        F.col("unique_order_days").alias("Unique_Order_Days"),
        F.col("orders_per_day").alias("Orders_Per_Day"),
        F.col("first_order").alias("First_Order"), F.col("last_order").alias("Last_Order"),
    )


def backfill_fields(old: DataFrame, frequency_threshold: int = 20) -> DataFrame:
    """Derives the columns an older outlet table may lack."""
    out, have = old, set(old.columns)
    if "active_days" not in have and {"first_order", "last_order"} <= have:
        out = out.withColumn("active_days", F.greatest(F.datediff("last_order", "first_order") + 1, F.lit(1)))
        have.add("active_days")
    if "orders_per_day" not in have and "orders_count" in have:
        per = F.col("orders_count") / F.nullif("active_days", F.lit(0)) if "active_days" in have else F.col("orders_count")
        out = out.withColumn("orders_per_day", per)
    basis = next((c for c in ("unique_order_days", "orders_count") if c in have), None)
    freq = F.coalesce(F.col(basis), F.lit(0)) if basis else F.lit(0)
    out = out.withColumn("F_label", F.when(freq >= frequency_threshold, "High").otherwise("Low"))
    out = out.withColumn("F_cluster_id", (freq >= frequency_threshold).cast("int"))
    if {"M_label", "AOV"} <= have:
        means = out.agg(
            F.struct(F.avg(F.when(F.col("M_label") == "High", F.col("AOV"))).alias("h"),
                     F.avg(F.when(F.col("M_label") == "Low", F.col("AOV"))).alias("l")).alias("m")
        ).scalar()
        swapped = F.coalesce(means["h"] < means["l"], F.lit(False))
        out = out.withColumn(
            "M_label",
            F.when(swapped & (F.col("M_label") == "High"), "Low")
            .when(swapped & (F.col("M_label") == "Low"), "High").otherwise(F.col("M_label")),
        )
    return rfm_segment(out) if {"R_label", "M_label"} <= have else out
