"""Column-level building blocks. All stay inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c) -> Column:
    return F.trim(F.regexp_replace(F.upper(col(c)), r"\s+", " "))


def norm_size(c) -> Column:
    """Pack key: upper case without spaces; bare numbers and `12ML` become `12-ML`."""
    s = F.trim(F.regexp_replace(F.upper(col(c)), " ", ""))
    return (
        F.when(s.isin("12", "12ML"), "12-ML").when(s.isin("18", "18ML"), "18-ML").otherwise(s)
    )


def number(c) -> Column:
    """Unparsable text becomes null."""
    return col(c).cast("string").try_cast("double")


def slab_number(c) -> Column:
    return F.regexp_extract(F.lower(F.trim(col(c))), r"(\d+)", 1).try_cast("int")


def allowed_slab(c, include_zero: bool = False) -> Column:
    return F.coalesce(slab_number(c) >= (0 if include_zero else 1), F.lit(False))


def slab_index(c) -> Column:
    n = slab_number(c)
    return F.when(n >= 1, n)


def outlet_group(c) -> Column:
    s = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), " ", "")
    return F.when(s == "WH", "WH").when(F.trim(s) == "", "").otherwise("OtherGT")


def ratio(num, den, scale: float = 1.0, default=None) -> Column:
    """num / den * scale; a zero or missing denominator gives `default`."""
    d = col(den)
    r = F.when(d != 0, col(num) / d * F.lit(scale))
    return r if default is None else F.coalesce(r, F.lit(default))


def positive_ratio(num, den, scale: float = 1.0, default=None) -> Column:
    """As `ratio`, but only a denominator above zero counts."""
    d = col(den)
    r = F.when(d > 0, col(num) / d * F.lit(scale))
    return r if default is None else F.coalesce(r, F.lit(default))


def delta_pct(new, old, default=0.0) -> Column:
    """Percent change against a positive base."""
    return F.coalesce(F.when(col(old) > 0, (col(new) - col(old)) / col(old) * 100.0), F.lit(default))


def delta_pct_abs(new, old, default=0.0) -> Column:
    """Percent change against the size of a base that may be negative."""
    return F.coalesce(
        F.when(F.abs(col(old)) > 1e-9, (col(new) - col(old)) / F.abs(col(old)) * 100.0),
        F.lit(default),
    )


def round_step(c, step: float = 0.5) -> Column:
    """Half-even rounding to a multiple of `step` (at least 0.1)."""
    s = F.lit(max(float(step), 0.1))
    return F.rint(col(c) / s) * s


def half_even(c) -> Column:
    return F.rint(col(c))


def month_of(c) -> Column:
    return F.trunc(col(c), "MM")


def week_of(c) -> Column:
    return F.date_trunc("week", col(c)).cast("date")


def period_of(c, grain: str) -> Column:
    return {"D": lambda x: x, "W": week_of, "M": month_of}[grain](col(c))


def clip(c, low=None, high=None) -> Column:
    out = col(c)
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def fmt_g(c) -> Column:
    """Plain number text: whole values without a decimal point."""
    v = col(c)
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def fiscal_year(c) -> Column:
    """Calendar year in which the Apr-Mar year ends."""
    return F.year(col(c)) + F.when(F.month(col(c)) >= 4, 1).otherwise(0)


def fiscal_label(c) -> Column:
    return F.concat(F.lit("FY"), F.right(fiscal_year(c).cast("string"), F.lit(2)))


def total(c) -> Column:
    """Sum over a result table whose row count is bounded by its group keys."""
    return F.sum(col(c)).over(Window.partitionBy(F.lit(1)))


def half_up(c, digits: int, kept: int = 8) -> Column:
    """Rounded half up in DECIMAL, from `kept` digits, so that a tie does not hang on the last bit of a double."""
    return F.round(col(c).cast(f"decimal(38,{kept})"), digits).cast("double")
