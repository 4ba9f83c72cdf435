"""Column-level numeric helpers; all JVM-side built-ins, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DataType, DecimalType, DoubleType, FloatType,
                               IntegerType, LongType, ShortType, StringType)

from shelfscope.functions.text import WHITESPACE

# Fixed value: text accepted as a number (trimmed); anything else becomes NULL.
NUMBER_PATTERN = r"[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
_SPACES = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
#: The number as group 1, in one match of the whole text.
_TRIMMED_NUMBER = rf"\A[{_SPACES}]*({NUMBER_PATTERN})[{_SPACES}]*\z"

INTEGRAL = (ByteType, ShortType, IntegerType, LongType)


def is_exact(dtype: DataType) -> bool:
    return isinstance(dtype, INTEGRAL + (DecimalType,))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column, dtype: DataType) -> Column:
    """``to_numeric(errors='coerce')``: text must match NUMBER_PATTERN, NaN is NULL.

    Exact types (integers, decimals) are returned unchanged. The column is named once in the
    expression, so that a text is matched once a row; a match is never NaN.
    """
    if is_exact(dtype):
        return c
    if isinstance(dtype, (DoubleType, FloatType)):
        return nan_to_null(c.cast("double"))
    text = c if isinstance(dtype, StringType) else c.cast("string")
    return F.regexp_extract(text, _TRIMMED_NUMBER, 1).try_cast("double")


def half_up_ratio(n: Column, d: Column, places: int = 4) -> Column:
    """round(n / d, places) for non-negative integers, ties away from zero.

    Computed with integral ``div`` so that every engine gives the same double:
    ((2 * 10^p * n + d) div (2 * d)) / 10^p. NULL when d is 0.
    """
    scale = 10 ** places
    num = F.lit(2 * scale).cast("long") * n.cast("long") + d.cast("long")
    den = F.lit(2).cast("long") * d.cast("long")
    return F.when(d > 0, F.call_function("div", num, den) / F.lit(float(scale)))


def unit_draw(key: Column) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(key): same on every engine,
    stable under any repartitioning or executor retry."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") \
        / F.lit(4294967296.0)
