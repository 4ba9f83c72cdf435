"""A12 profit and loss, A13 annual expenditure."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, StringType, TimestampNTZType, TimestampType)

from shelfscope.functions import exact
from shelfscope.functions.numeric import is_exact, to_number
from shelfscope.operators import schema

# Notes.
NO_COST_SELL = "Cost and selling price columns not found."
NO_EXPENDITURE = "No expenditure column found."
NO_DATE = "No date/year column found."
NO_YEARS = "No valid yearly expenditure data found."
#: Date formats; ``elected_formats`` orders them for a column. ISO forms first, then month before day, then day before
#: month, then month names.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]", "yyyy/M/d", "yyyy/M/d HH:mm:ss",
    "M/d/yyyy", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "d/M/yyyy", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "yyyyMMdd",
)


def _number(df: DataFrame, name: str) -> Column:
    return to_number(F.col(name), df.schema[name].dataType)


def _measure(df: DataFrame, name: str, c: Column) -> Column:
    # exact inputs stay exact, all others are doubles
    return c if is_exact(df.schema[name].dataType) else c.cast("double")


def profit_loss(df: DataFrame) -> DataFrame:
    """value = (sell - cost) x qty per row; totals of positive values,
    of negated negative values, and of all values. Cost/sell NULL -> 0, qty NULL -> 1."""
    spark = df.sparkSession
    cost = schema.resolve(df, schema.COST)
    sell = schema.resolve(df, schema.SELL)
    qty = schema.resolve(df, schema.QUANTITY)
    out_schema = ("available boolean, total_profit double, total_loss double, "
                  "net_profit double, basis string, note string")
    if cost is None or sell is None:
        return spark.createDataFrame([(False, None, None, None, None, NO_COST_SELL)], out_schema)
    c = F.coalesce(_number(df, cost), F.lit(0))
    s = F.coalesce(_number(df, sell), F.lit(0))
    if qty:
        q = _measure(df, qty, F.coalesce(_number(df, qty), F.lit(1)))
    else:
        q = F.lit(1)
    value = (_measure(df, sell, s) - _measure(df, cost, c)) * q
    basis = f"Computed from {sell} - {cost} x {qty or '_qty'}"
    lines = df.select(value.alias("v"))
    v = F.col("v")
    return exact.aggregate(lines, [], [
        exact.total(lines, F.when(v > 0, v), "total_profit", default=0.0),
        exact.total(lines, F.when(v < 0, -v), "total_loss", default=0.0),
        exact.total(lines, v, "net_profit", default=0.0),
    ]).select(F.lit(True).alias("available"), "total_profit", "total_loss", "net_profit",
             F.lit(basis).alias("basis"), F.lit(None).cast("string").alias("note"))


#: What a field of a date format may read, for ``_shape``: every text that Spark's parser takes, in range, and few others.
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_FIELDS = {"yyyy": "[+-]?[0-9]{4,}", "M": "0*(?:1[0-2]|[1-9])", "MM": "(?:1[0-2]|0[1-9])", "d": "0*(?:[12][0-9]|3[01]|[1-9])",
           "dd": "(?:[0-2][0-9]|3[01])", "HH": "[0-2][0-9]", "mm": "[0-5][0-9]", "ss": "[0-5][0-9]", "MMM": "[^0-9]{3,5}",
           "MMMM": f"(?:{_MONTHS})", "XXX": "[^0-9]?[0-9:]*"} | {"S" * n: f"[0-9]{{{n}}}" for n in range(1, 7)}
_TOKEN = re.compile(r"'([^']+)'|([A-Za-z])\2*|[\[\]]|[^A-Za-z']")


def _shape(date_format: str) -> str | None:
    """A pattern that every text of the format matches (and others too), None for formats that hold fields unknown here."""
    parts, end = [], 0
    for m in _TOKEN.finditer(date_format):
        if m.start() != end:
            return None
        end, token = m.end(), m.group()
        if m.group(1):
            parts.append(re.escape(m.group(1)))
        elif m.group(2):
            if token not in _FIELDS:
                return None
            parts.append(_FIELDS[token])
        else:
            parts.append({"[": "(?:", "]": ")?"}.get(token) or re.escape(token))
    return f"(?i)\\A{''.join(parts)}\\z" if end == len(date_format) else None


def _parsed(text: Column, date_format: str) -> Column:
    """The text as a timestamp, null if it has another format. Only a text of the format's shape is parsed:
    a failed parse costs many times a match."""
    parsed, shape = F.try_to_timestamp(text, F.lit(date_format)), _shape(date_format)
    return parsed if shape is None else F.when(text.rlike(shape), parsed)


def elected_formats(df: DataFrame, name: str, date_formats: Sequence[str] = DATE_FORMATS) -> list[str]:
    """The formats that dates of a text column have, the commonest first, from one pass that counts what fits.

    Whether day or month comes first is settled for the column: a date such as 25/12/2021 fits one
    order only, and the order that more dates fit is tried before the other one (month first in a tie). A
    mixed column keeps its further formats behind; a column of one form is parsed once a row.
    """
    text = F.trim(F.col(name))
    fits = df.agg(*[F.count(_parsed(text, f)).alias(f"f{i}") for i, f in enumerate(date_formats)]).first()
    number = dict(zip(date_formats, fits))
    # beside each format that has a twin of the other order
    twin = {f: f.replace("d", "\0").replace("M", "d").replace("\0", "M") for f in date_formats if "MMM" not in f}
    paired = [f for f in date_formats if twin.get(f, f) != f and twin[f] in number and not f.startswith("y")]
    day_first = sum(number[f] for f in paired if f.startswith("d")) > sum(number[f] for f in paired if f.startswith("M"))
    behind = {f for f in paired if f.startswith("M" if day_first else "d")}
    order = sorted((f in behind, -number[f], i) for i, f in enumerate(date_formats) if number[f])
    return [date_formats[i] for *_, i in order]


def year_of(df: DataFrame, name: str, date_formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Year of a date role: numeric coercion for ``year``, parsing otherwise.

    Text is parsed by ``date_formats`` in their order (see ``elected_formats``). Numbers in a date column are no dates here (a reader would have to guess their
    unit), so they raise ``NumericDates``.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if name == "year":
        return F.floor(_number(df, name)).cast("int")
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return F.year(c)
    if not isinstance(dtype, StringType):
        raise NumericDates(f"{name} holds {dtype.simpleString()}, not dates; rename it to year or convert it")
    text = F.trim(c)
    return F.year(F.coalesce(*[_parsed(text, f) for f in date_formats], F.lit(None).cast("timestamp")))


def _elected(df: DataFrame, name: str, date_formats: Sequence[str] | None) -> Sequence[str]:
    """The formats that a caller names, in that order; else those of the column, if it is text."""
    if date_formats is not None or name == "year" or not isinstance(df.schema[name].dataType, StringType):
        return date_formats or ()
    return elected_formats(df, name)


class NumericDates(ValueError):
    pass


def annual_expenditure(df: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    """A13 first level: expenditure summed per year (NULL spend counts 0). Without
    ``date_formats``, those of a text column are elected when this is called."""
    exp = schema.resolve(df, schema.EXPENDITURE)
    date = schema.resolve(df, schema.DATE)
    if exp is None or date is None:
        return df.sparkSession.createDataFrame([], "year int, expenditure double")
    spend = _measure(df, exp, F.coalesce(_number(df, exp), F.lit(0)))
    lines = df.select(year_of(df, date, _elected(df, date, date_formats)).alias("year"), spend.alias("e")).where(F.col("year").isNotNull())
    if is_exact(df.schema[exp].dataType):
        return lines.groupBy("year").agg(F.sum("e").alias("e"))
    return exact.aggregate(lines, ["year"], [exact.total(lines, "e", "e")])


def unparsed_dates(df: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    """One row: dates that are there but fit none of the formats (their spend is in no year)."""
    date = schema.resolve(df, schema.DATE)
    if date is None:
        return df.sparkSession.createDataFrame([(0,)], "unparsed_dates long")
    missed = F.col(date).isNotNull() & year_of(df, date, _elected(df, date, date_formats)).isNull()
    return df.agg(F.count_if(missed).alias("unparsed_dates"))


def avg_annual_expenditure(df: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    """Mean of the per-year sums, with the ascending year list as text. The note
    counts dates that fit none of the formats."""
    spark = df.sparkSession
    out_schema = "available boolean, average_annual_expenditure double, years string, note string"
    if schema.resolve(df, schema.EXPENDITURE) is None:
        return spark.createDataFrame([(False, None, None, NO_EXPENDITURE)], out_schema)
    if schema.resolve(df, schema.DATE) is None:
        return spark.createDataFrame([(False, None, None, NO_DATE)], out_schema)
    date_formats = _elected(df, schema.resolve(df, schema.DATE), date_formats)
    per_year = annual_expenditure(df, date_formats)
    missed = unparsed_dates(df, date_formats).scalar()
    # one row per year: the list is as long as the calendar span, not the data
    if is_exact(per_year.schema["e"].dataType):
        total = F.sum("e")
    else:  # in order of the years
        total = F.aggregate(F.sort_array(F.collect_list(F.struct("year", "e"))), F.lit(0.0), lambda a, y: a + F.coalesce(y["e"], F.lit(0.0)))
    agg = per_year.agg(F.count(F.lit(1)).alias("n_years"), total.alias("total"),
                       F.sort_array(F.collect_list("year")).alias("ys"))
    ok = F.col("n_years") > 0
    return agg.select(
        ok.alias("available"),
        F.when(ok, F.col("total").cast("double") / F.col("n_years")).alias("average_annual_expenditure"),
        F.when(ok, F.array_join(F.col("ys").cast("array<string>"), ",")).alias("years"),
        F.when(~ok, F.lit(NO_YEARS)).when(missed > 0, F.concat(
            missed.cast("string"), F.lit(" dates could not be read."))).alias("note"))


def annual_expenditure_table(df: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    return annual_expenditure(df, date_formats).select("year", F.col("e").cast("double").alias("expenditure"))
