"""Aggregates whose digits do not depend on how the rows are dealt to tasks.

Decimals are summed natively. Doubles are summed as integers: a value of at most
six decimals as a count of millionths, any other one as its binary mantissa within a bin of
``BIN`` exponents. Values of one bin are added as longs, in two halves that cannot
overflow; sums of different bins are put together in a fixed order at the end. A bin is a
further grouping key of the first aggregation, so a table of ordinary figures has one bin and
costs no more rows than without.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, LongType

from shelfscope.functions.numeric import is_exact, nan_to_null

#: Exponents of two that share a bin, and bits of a half.
BIN, HALF = 8, 30
#: Counts of millionths below this are exact in a double's arithmetic.
LARGEST = float(1 << 50)
#: Bins hold from here on; 0 is that of the millionths.
ORDINARY, LOWEST, INFINITE = 0, 1000, 5000


@dataclass
class Part:
    """A column of the running state: what the rows give (None: it comes from a lift or
    a key), and how states are merged."""
    name: str
    first: Column | None
    merge: Callable[[str], Column] = F.sum


@dataclass
class Figure:
    """A figure of a group: ``parts`` are merged any number of times, ``finish`` reads them.

    ``keys`` are further columns that the first aggregation groups by; ``lift``
    turns their rows into states.
    """
    name: str
    parts: list[Part]
    finish: Column
    keys: dict[str, Column] = field(default_factory=dict)
    lift: dict[str, Column] = field(default_factory=dict)


def _pow2(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def _state(c: Column, dtype: DataType, name: str) -> tuple[list[Part], dict, dict, Column, Column]:
    """(parts, keys, lift, sum, count) of a column; the sum is null without values."""
    count = Part(f"{name}_n", F.count(c))
    n = F.col(f"{name}_n")
    if is_exact(dtype) and not isinstance(dtype, LongType):
        sized = c if isinstance(dtype, DecimalType) else c.cast("long")
        return [Part(f"{name}_s", F.sum(sized)), count], {}, {}, F.col(f"{name}_s").cast("double"), n
    hi, lo, odd = f"{name}_hi", f"{name}_lo", f"{name}_odd"
    both = (F.col(hi).cast("decimal(20,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + F.col(lo).cast("decimal(20,0)"))

    def halves(whole: Column) -> list[Part]:
        return [Part(hi, F.sum(F.shiftright(whole, HALF))), Part(lo, F.sum(whole.bitwiseAND(F.lit((1 << HALF) - 1))))]

    if isinstance(dtype, LongType):
        return [*halves(c), count], {}, {}, both.cast("double"), n
    x = nan_to_null(c.cast("double"))
    count = Part(f"{name}_n", F.count(x))
    millionths = F.rint(x * F.lit(1e6))
    fits = (F.abs(millionths) < LARGEST) & (millionths / F.lit(1e6) == x)
    infinite = F.abs(x) == float("inf")
    exponents = F.floor(F.log2(F.abs(x)) / BIN)
    kind = F.when(x.isNull() | fits, ORDINARY).when(infinite, F.signum(x) * INFINITE).otherwise(exponents + LOWEST).cast("int")
    # the mantissa as an integer; two steps, as one power may leave the range of doubles
    shift = F.lit(54) - exponents * BIN
    half = F.floor(shift / 2)
    mantissa = x * _pow2(half) * _pow2(shift - half)
    # what is no value of the branch stays out of its cast
    whole = F.when(fits, millionths.try_cast("long")).when(infinite, F.lit(0)).otherwise(mantissa.try_cast("long"))
    key = f"{name}_bin"
    unit = _pow2(((F.col(key) - LOWEST) * BIN - 54) / 2)
    value = (F.col(hi).cast("double") * float(1 << HALF) + F.col(lo).cast("double")) * unit * unit
    value = F.when(F.abs(F.col(key)) == INFINITE, F.signum(F.col(key)) * float("inf")).otherwise(value)
    usual = F.col(key) == ORDINARY
    lift = {hi: F.when(usual, F.col(hi)), lo: F.when(usual, F.col(lo)), odd: F.when(~usual, F.array(value))}
    parts = [*halves(whole), Part(odd, None, lambda p: F.flatten(F.collect_list(p))), count]
    rest = F.aggregate(F.sort_array(odd), F.lit(0.0), lambda a, v: a + v)
    ordinary = (F.coalesce(both, F.lit(0)) * F.lit("0.000001").cast("decimal(7,6)")).cast("double")
    total = F.when(n > 0, F.when(F.size(odd) > 0, ordinary + rest).otherwise(ordinary))
    return parts, {key: kind}, lift, total, n


def total(df: DataFrame, c: Column | str, name: str, default: float | None = None) -> Figure:
    """Sum as a double; ``default`` where there are no values."""
    c = F.col(c) if isinstance(c, str) else c
    parts, keys, lift, value, _ = _state(c, df.select(c).schema[0].dataType, f"_{name}")
    return Figure(name, parts, value if default is None else F.coalesce(value, F.lit(default)), keys, lift)


def mean(df: DataFrame, c: Column | str, name: str) -> Figure:
    """Mean of the values; null where there are none."""
    c = F.col(c) if isinstance(c, str) else c
    parts, keys, lift, value, n = _state(c, df.select(c).schema[0].dataType, f"_{name}")
    return Figure(name, parts, F.try_divide(value, n.cast("double")), keys, lift)


def count(name: str, condition: Column | None = None) -> Figure:
    """Rows, or those for which the condition is true."""
    rows = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return Figure(name, [Part(f"_{name}", rows)], F.coalesce(F.col(f"_{name}"), F.lit(0)))


def least(c: Column, name: str) -> Figure:
    return Figure(name, [Part(f"_{name}", F.min(c), F.min)], F.col(f"_{name}").cast("double"))


def most(c: Column, name: str) -> Figure:
    return Figure(name, [Part(f"_{name}", F.max(c), F.max)], F.col(f"_{name}").cast("double"))


def distinct(c: str, name: str) -> Figure:
    """Distinct values of a column; the column is a key of the first aggregation. Its state
    is not mergeable further."""
    return Figure(name, [Part(f"_{name}", None, lambda p: F.countDistinct(f"{p}_key"))], F.col(f"_{name}"),
                  {f"_{name}_key": F.col(c)})


def fixed(value: Column, name: str) -> Figure:
    """A figure that is the same for every group."""
    return Figure(name, [], value)


def binned(df: DataFrame, keys: Sequence[str], figures: Sequence[Figure]) -> DataFrame:
    """The first aggregation: whole numbers for every group and bin, which add up exactly with those of other rows."""
    further = {name: c for f in figures for name, c in f.keys.items()}
    first = [p.first.alias(p.name) for f in figures for p in f.parts if p.first is not None]
    return df.withColumns(further).groupBy(*keys, *further).agg(*(first or [F.lit(0).alias("_none")]))


def rebinned(rows: DataFrame, keys: Sequence[str], figures: Sequence[Figure]) -> DataFrame:
    """Rows of several ``binned`` tables as those of one."""
    further = [name for f in figures for name in f.keys]
    return rows.groupBy(*keys, *further).agg(*[p.merge(p.name).alias(p.name) for f in figures for p in f.parts if p.first is not None])


def states(df: DataFrame, keys: Sequence[str], figures: Sequence[Figure]) -> DataFrame:
    """The running state of every group, one row for each: what ``merged`` and ``finished`` take."""
    return lifted(binned(df, keys, figures), keys, figures)


def lifted(rows: DataFrame, keys: Sequence[str], figures: Sequence[Figure]) -> DataFrame:
    """States of ``binned`` rows."""
    if not any(f.keys for f in figures):
        return rows
    return merged(rows.withColumns({name: c for f in figures for name, c in f.lift.items()}), keys, figures)


def merged(rows: DataFrame, keys: Sequence[str], figures: Sequence[Figure], *others: Column) -> DataFrame:
    """States merged per group of ``keys``; ``others`` are further aggregates of the rows."""
    return rows.groupBy(*keys).agg(*[p.merge(p.name).alias(p.name) for f in figures for p in f.parts], *others)


def finished(rows: DataFrame, keys: Sequence[str], figures: Sequence[Figure], *others: str) -> DataFrame:
    return rows.select(*keys, *others, *[f.finish.alias(f.name) for f in figures])


def aggregate(df: DataFrame, keys: Sequence[str], figures: Sequence[Figure]) -> DataFrame:
    """One row for every group of ``keys`` (one row in all without keys) with its figures."""
    return finished(states(df, keys, figures), keys, figures)
