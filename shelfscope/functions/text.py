"""String helpers: whitespace strip, label truncation and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used in generated text.
CURRENCY = "₹"
ELLIPSIS = "…"


# The characters Python's ``str.strip()`` removes (``str.isspace``).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
              "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: removes leading/trailing whitespace of every kind
    (Spark's ``trim`` removes spaces only). Most values need no change, so the
    trim runs only when the first or last character is whitespace."""
    ws = list(WHITESPACE)
    edge = F.substring(c, 1, 1).isin(ws) | F.substring(c, -1, 1).isin(ws)
    return F.when(edge, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def clean_item(c: Column) -> Column:
    """``astype(str).str.strip()`` on a product or item name."""
    return py_strip(c.cast("string"))


def truncate_label(c: Column, width: int = 22) -> Column:
    """First ``width`` characters plus an ellipsis when longer."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit(ELLIPSIS))) \
        .otherwise(c)


def fmt_grouped(x: Column, decimals: int = 0) -> Column:
    """Python ``{:,.Nf}``: grouped thousands, N decimals."""
    return F.format_number(x, decimals)


def fmt_plain(x: Column, decimals: int = 1) -> Column:
    """Python ``{:.Nf}``: N decimals, no grouping."""
    return F.regexp_replace(F.format_number(x, decimals), ",", "")


def money(x: Column) -> Column:
    """``₹{x:,.0f}``."""
    return F.concat(F.lit(CURRENCY), fmt_grouped(x, 0))


def percent(x: Column, decimals: int = 2) -> Column:
    """Python ``{:.2%}``."""
    return F.concat(fmt_plain(x * F.lit(100.0), decimals), F.lit("%"))
