"""Column names, types and parameter objects shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The canonical fact columns.
TEXT_COLUMNS = [
    "Outlet_ID", "Bill_No", "Final_State", "Final_Outlet_Classification", "Outlet_Type",
    "State", "Category", "Subcategory", "Brand", "Sizes", "Slab", "Sku_Code", "Sku_Name",
]
MEASURES = [
    "Quantity", "MRP", "Net_Amt", "SalesValue_atBasicRate", "TotalDiscount",
    "Scheme_Discount", "Staggered_qps", "Basic_Rate_Per_PC_without_GST",
    "Basic_Rate_Per_PC", "Selling_Rate_Per_PC_without_GST_CLP",
]
FACT_COLUMNS = [
    "Date", "Outlet_ID", "Bill_No", "Final_State", "Final_Outlet_Classification",
    "Outlet_Type", "State", "Category", "Subcategory", "Brand", "Sizes", "Slab",
    "Quantity", "MRP", "Net_Amt", "SalesValue_atBasicRate", "TotalDiscount",
    "Scheme_Discount", "Staggered_qps", "Basic_Rate_Per_PC_without_GST",
    "Basic_Rate_Per_PC", "Selling_Rate_Per_PC_without_GST_CLP", "Sku_Code", "Sku_Name",
]
NORMALIZED_DIMS = [
    "Category", "Subcategory", "Brand", "Final_State",
    "Final_Outlet_Classification", "Outlet_Type",
]

FACT_SCHEMA = T.StructType([
    T.StructField(
        c,
        T.DateType() if c == "Date" else T.DoubleType() if c in MEASURES else T.StringType(),
    )
    for c in FACT_COLUMNS
])

SEGMENTS = [f"{r}-{f}-{m}" for r in ("Recent", "Stale") for f in ("High", "Low") for m in ("High", "Low")]
PACK_SIZES = ["12-ML", "18-ML"]


@dataclass(frozen=True)
class Filters:
    """Base scope. An empty tuple leaves that dimension alone."""

    states: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    sizes: tuple[str, ...] = ()
    outlet_classifications: tuple[str, ...] = ()


@dataclass(frozen=True)
class RfmParams:
    recency_days: int = 90
    frequency_threshold: int = 20
    #: Register bits of a sketch that estimates the order days of an outlet; None counts them.
    sketch_bits: int | None = None

    def __post_init__(self):
        if self.recency_days < 0 or self.frequency_threshold < 1:
            raise ValueError("recency_days must be >= 0 and frequency_threshold >= 1")


@dataclass(frozen=True)
class SlabRules:
    """`mode` is "data" (slab column as given) or "define" (recomputed from thresholds)."""

    mode: str = "data"
    thresholds: tuple[float, ...] = (8.0, 32.0, 576.0, 960.0)
    per_size: dict = field(default_factory=dict)


@dataclass(frozen=True)
class BaseParams:
    """Base depth estimator. `mode`: "data" uses day blocks, "define" whole months."""

    mode: str = "define"
    grain: str = "M"
    min_up: float = 1.0
    min_down: float = 1.0
    round_step: float = 0.5

    def __post_init__(self):
        if self.mode not in ("data", "define"):
            raise ValueError("mode must be 'data' or 'define'")
        if self.grain not in ("D", "W", "M"):
            raise ValueError("grain must be D, W or M")


# Penalties tried by the search, cost per unit and the planner's discount range.
L2_CROSS_SLAB = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
L2_FULL = (0.0, 0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
COGS_DEFAULTS = {"12-ML": 6.0, "18-ML": 8.0}
LADDER_MIN, LADDER_MAX = 5.0, 30.0


@dataclass(frozen=True)
class ModelParams:
    include_lag: bool = True
    l2: float = 0.1
    optimize_l2: bool = True
    candidates: tuple[float, ...] = L2_CROSS_SLAB
    round_step: float = 0.5
    cogs_per_size: dict = field(default_factory=dict)
    cogs_per_unit: float | None = None
    include_other_slabs: bool = False

    def __post_init__(self):
        if self.l2 < 0:
            raise ValueError("l2 must be >= 0")
