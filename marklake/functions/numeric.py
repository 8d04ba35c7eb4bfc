"""Number expressions whose results must equal Python's float arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def round_even(x: Column, places: int = 0) -> Column:
    """Round half-even on the exact binary value; NULL stays NULL.

    ``F.round`` is half-up and ``F.bround`` looks at the printed decimal, so both
    differ from a float round on values such as 2.675. ``rint`` of x * 10**n is
    right unless that product looks like a tie; then the rounding error of the
    product (split-and-multiply, exact) tells on which side x lies.
    """
    x = x.cast("double")
    if places == 0:
        return F.rint(x)
    scale = F.lit(float(10**places))
    product = x * scale
    whole = F.rint(product)
    off = product - whole
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    error = (high * scale - product) + (x - high) * scale
    return (whole + F.when((F.abs(off) == 0.5) & (off * error > 0), 2.0 * off).otherwise(0.0)) / scale


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Round columns in a step of their own, so a long expression is computed once."""
    return df.withColumns({name: round_even(F.col(name), n) for name, n in places.items()})


def clamp(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    """Clamp that keeps NULL (greatest/least alone would drop it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def ratio(num: Column, den: Column, default: Column | float | None = None) -> Column:
    """num/den where den > 0, else the default."""
    if default is None:
        fallback = F.lit(None).cast("double")
    else:
        fallback = default if isinstance(default, Column) else F.lit(float(default))
    return F.when(den > 0, num / den).otherwise(fallback)


def percent(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, num / den * 100.0).otherwise(F.lit(float(default)))


def as_ratio(x: Column) -> Column:
    """Values above 1 are percentages; the result is clamped to [0, 1]."""
    return clamp(F.when(x > 1.0, x / 100.0).otherwise(x))


def fmt_g(x: Column) -> Column:
    """``%g`` text of a mark: six significant digits, no trailing zeros.

    Marks lie in [1e-4, 1e6) and carry at most four decimals. Only a mark whose
    seventh significant digit is a lone 5 is rounded on its printed form.
    """
    text = F.regexp_replace(F.format_string("%.6g", x.cast("double")), r"\.0+$|(\.\d*[1-9])0+$", "$1")
    return F.when(x.isNotNull(), text)


def fmt_fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", round_even(x, places))


def fmt_float(x: Column) -> Column:
    """A mark as a Python float prints it ("3.0", "2.25")."""
    return x.cast("double").cast("string")
