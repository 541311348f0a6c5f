"""Reading monthly drops whose column names and types drift, and tidying them into the fact table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tradelift.functions.columns import col, norm_size, norm_text, number
from tradelift.functions.lineage import cut
from tradelift.schema import FACT_COLUMNS, MEASURES, NORMALIZED_DIMS

# Source spellings and the canonical column each one fills.
ALIASES = {
    "subcategory": "Subcategory", "sizes": "Sizes", "brand": "Brand", "category": "Category",
    "variant": "Variant", "bill_no": "Bill_No", "invoice_no": "Invoice_No",
    "sales_order_no": "Sales_Order_No", "sku_code": "Sku_Code", "sku_name": "Sku_Name",
    "outlet_type": "Outlet_Type", "store_id": "Store_ID", "final_state": "Final_State",
    "final_outlet_classification": "Final_Outlet_Classification", "state": "State", "mrp": "MRP",
    "scheme_discount": "Scheme_Discount", "staggered_qps": "Staggered_qps",
    "basic_rate_per_pc_without_gst": "Basic_Rate_Per_PC_without_GST",
    "basic_rate_per_pc": "Basic_Rate_Per_PC",
    "selling_rate_without_gst_clp": "Selling_Rate_Per_PC_without_GST_CLP",
}
# State spellings and name parts. A later token wins over an earlier one.
STATE_NAMES = {
    "MAHARASHTRA": "MAH", "MAHARASHTRA STATE": "MAH", "MH": "MAH", "MAH": "MAH",
    "UTTARPRADESH": "UP", "UTTAR PRADESH": "UP", "U P": "UP", "UP": "UP",
}
STATE_TOKENS = {"MAH": ("MAHARASHTRA", "MUMBAI", "VIDARBHA"), "UP": ("U.P", "UP", "UTTAR PRADESH")}
SCOPE_SIZES = ("12-ML", "18-ML")


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def unify_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES, by_slug: bool = False) -> DataFrame:
    """Renames known spellings. A canonical column that is already there is never replaced; with
    `by_slug` any punctuation or case variant of an alias counts, first column first."""
    have = set(df.columns)
    chosen: dict[str, str] = {}
    for c in df.columns:
        target = aliases.get(slug(c) if by_slug else c)
        if target and target not in have and target not in chosen.values():
            chosen[c] = target
    return df.select(*[F.col(f"`{c}`").alias(chosen.get(c, c)) for c in df.columns])


def require_columns(df: DataFrame, needed, raise_error: bool = True) -> list[str]:
    missing = [c for c in needed if c not in df.columns]
    if missing and raise_error:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return missing


def stable_schema(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns; bill number and net amount are derived when absent."""
    have = set(df.columns)

    def source(c: str) -> Column:
        if c in have:
            return F.col(c)
        if c == "Bill_No":
            alt = next((a for a in ("Invoice_No", "Sales_Order_No") if a in have), None)
            return F.col(alt) if alt else F.lit(None)
        if c == "Net_Amt":
            part = [F.coalesce(number(x), F.lit(0.0)) if x in have else F.lit(0.0)
                    for x in ("SalesValue_atBasicRate", "TotalDiscount")]
            return part[0] - part[1]
        return F.lit(None)

    def typed(c: str) -> Column:
        # Measures keep their source type here; coerce_numeric decides what is a number.
        if c == "Date":
            return source(c).cast("string").try_cast("timestamp").cast("date")
        return source(c) if c in MEASURES else source(c).cast("string")

    return df.select(*[typed(c).alias(c) for c in FACT_COLUMNS])


def coerce_numeric(df: DataFrame, measures=MEASURES) -> DataFrame:
    return df.withColumns({c: number(c) for c in measures if c in df.columns})


def normalize_text_dims(df: DataFrame, dims=NORMALIZED_DIMS) -> DataFrame:
    return df.withColumns({c: norm_text(c) for c in dims if c in df.columns})


def normalize_size(df: DataFrame) -> DataFrame:
    return df.withColumn("Sizes", norm_size("Sizes"))


def canonical_state(c) -> Column:
    s = norm_text(c)
    exact = s
    for name, code in STATE_NAMES.items():
        exact = F.when(s == name, code).otherwise(exact)
    out = exact
    for code, tokens in STATE_TOKENS.items():
        out = F.when(exact.rlike("|".join(re.escape(t) for t in tokens)), code).otherwise(out)
    return F.when(col(c).isNotNull(), out)


def project_scope(df: DataFrame, subcategories, sizes=SCOPE_SIZES) -> DataFrame:
    """Rows of the named sub-categories (upper case, single spaces) and pack sizes."""
    return df.where(norm_text("Subcategory").isin(*subcategories) & norm_size("Sizes").isin(*sizes))


def invoice_key(outlet="Outlet_ID", bill="Bill_No", date="Date") -> Column:
    """Outlet, bill and day together, so that a reused bill number still counts apart."""
    return F.concat_ws(
        "|", F.coalesce(col(outlet).cast("string"), F.lit("")), F.coalesce(col(bill).cast("string"), F.lit("")),
        F.coalesce(F.date_format(col(date), "yyyy-MM-dd"), F.lit("")))


def store_key(df: DataFrame) -> DataFrame:
    """Store_Key from Store_ID if any row of the table has one, else distributor plus outlet."""
    sid = F.nullif(F.trim(F.col("Store_ID").cast("string")), F.lit("")) if "Store_ID" in df.columns else F.lit(None)
    paired = F.concat_ws(" ", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
                                for c in ("Distributor_ID", "Outlet_ID")]) \
        if {"Distributor_ID", "Outlet_ID"} <= set(df.columns) else None
    if "Store_ID" not in df.columns:
        if paired is None:
            raise ValueError("Need Store_ID, or both Distributor_ID and Outlet_ID")
        return df.withColumn("Store_Key", paired)
    if paired is None:
        return df.withColumn("Store_Key", sid)
    any_sid = F.coalesce(df.agg(F.bool_or(sid.isNotNull())).scalar(), F.lit(False))
    return df.withColumn("Store_Key", F.when(any_sid, sid).otherwise(paired))


def tidy(df: DataFrame, scope=None) -> DataFrame:
    """One drop into fact shape. `scope` is (subcategories, sizes) or None for everything."""
    out = coerce_numeric(stable_schema(unify_aliases(df)))
    out = normalize_size(normalize_text_dims(out))
    return out if scope is None else project_scope(out, *scope)


def list_drops(spark: SparkSession, folder: str) -> list[str]:
    """Entries ending in .parquet (files, or folders of part files), by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)]
    return [str(p.toString()) for p in sorted(found, key=lambda p: p.getName()) if p.getName().endswith(".parquet")]


def scan_transactions(spark: SparkSession, folder: str, scope=None, required=(), skipped: list | None = None) -> DataFrame:
    """All drops of a folder as one fact table. Drops with equal columns are read as one scan, so
    the plan has one branch per schema variant, not per file. Drops lacking a required column
    are an error unless `skipped` is a list, which then receives (path, columns it lacks); nothing is cached."""
    variants: dict[str, tuple[T.StructType, list[str]]] = {}
    for p in list_drops(spark, folder):
        schema = spark.read.parquet(p).schema
        variants.setdefault(schema.json(), (schema, []))[1].append(p)
    parts = []
    for schema, paths in variants.values():
        raw = spark.read.schema(schema).parquet(*paths)
        if lacking := require_columns(unify_aliases(raw), required, raise_error=skipped is None):
            skipped += [(p, lacking) for p in paths]
            continue
        parts.append(tidy(raw, scope))
    if not parts:
        raise ValueError(f"No usable parquet drops in {folder}")
    return union_drops(*parts)


def union_drops(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def reconcile_sources(left: DataFrame, right: DataFrame, value: str, tolerance: float = 0.0) -> DataFrame:
    """Month and size sums of two sources side by side with PASS or FAIL."""

    def sums(df, name):
        return df.groupBy(F.date_format(F.trunc("Date", "MM"), "yyyy-MM").alias("month"), F.col("Sizes").alias("size")).agg(
            F.sum(value).alias(name))

    return full_outer_diff(sums(left, "left_value"), sums(right, "right_value"), tolerance)


def full_outer_diff(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    diff = F.coalesce(F.col("right_value"), F.lit(0.0)) - F.coalesce(F.col("left_value"), F.lit(0.0))
    ok = F.col("left_value").isNotNull() & F.col("right_value").isNotNull() & (F.abs(diff) <= tolerance)
    return left.join(right, ["month", "size"], "full_outer").select(
        "month", "size", "left_value", "right_value", diff.alias("diff_value"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"))


# Month names of an Apr-Mar plan sheet.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FISCAL_ORDER = [4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3]


def month_number(c) -> Column:
    """Month from a number, a date text or an English month name."""
    text = F.trim(col(c).cast("string"))
    token = F.substring(F.regexp_replace(F.lower(text), "[^a-z]", ""), 1, 3)
    names = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS):
        names = F.when(token == m, F.lit(i + 1)).otherwise(names)
    plain = F.when(text.rlike(r"^\d{1,2}$"), text.try_cast("int"))
    return F.coalesce(
        F.when(plain.between(1, 12), plain),
        F.when(plain.isNull(), F.coalesce(F.month(text.try_cast("date")), names)))


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"Scenario {i + 1}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def read_plan_csv(spark: SparkSession, path: str) -> DataFrame:
    """A plan sheet with repeated headings kept apart."""
    head = [str(v) if v is not None else "" for v in spark.read.csv(path, header=False).first()]
    names = [head[0].strip()] + unique_names(head[1:])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_plan_grid(grid: DataFrame, validate: bool = True) -> DataFrame:
    """Month-by-scenario sheet to rows (scenario, plan_idx 0..11 from April, month_no, pct).

    The sheet must name all twelve months and hold 0..60 everywhere; the last row of a month
    counts."""
    month, *scenarios = grid.columns
    if not scenarios:
        raise ValueError("Need a month column and at least one scenario column")
    long = (
        grid.withColumn("__row", F.monotonically_increasing_id())
        .unpivot(["__row", month], [f"`{s}`" for s in scenarios], "scenario", "text")
        .withColumn("month_no", month_number(month)).where("month_no IS NOT NULL")
        .groupBy("scenario", "month_no").agg(F.max_by("text", "__row").alias("text"))
        .select(
            "scenario", F.pmod(F.col("month_no") - 4, F.lit(12)).alias("plan_idx"), "month_no",
            F.trim(F.regexp_replace(F.col("text").cast("string"), "%", "")).try_cast("double").alias("pct"))
    )
    if validate:
        # One upload sheet: at most twelve months, and only the first few faults are shown.
        long = cut(long)
        have = {r[0] for r in long.select("month_no").distinct().collect()}
        gaps = [MONTHS[m - 1].title() for m in FISCAL_ORDER if m not in have]
        if gaps:
            raise ValueError(f"Missing month rows: {', '.join(gaps)}")
        bad = long.where("pct IS NULL OR isnan(pct) OR pct < 0 OR pct > 60").limit(5).collect()
        if bad:
            raise ValueError("Discounts must be 0 to 60: " + "; ".join(f"{r.scenario} month {r.month_no}: {r.pct}" for r in bad))
    return long
