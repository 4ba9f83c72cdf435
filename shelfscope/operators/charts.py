"""Chart-ready series (data only; drawing is the caller's business)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.text import truncate_label
from shelfscope.operators import catalog
from shelfscope.operators.schema import requires


def top_products(df: DataFrame, n: int = 20, label_width: int = 22) -> DataFrame:
    """First n of the product sales series (label, value); without a sales
    basis, the first n products by name with their mean price."""
    sales = catalog.product_sales(df)
    if catalog.sales_basis(df) == "unavailable":
        products = catalog.product_list(df)
        if "price" not in products.columns:
            return df.sparkSession.createDataFrame([], "label string, value double")
        sales = products.where(F.col("price").isNotNull()) \
            .select("product_name", F.col("price").alias("value")).orderBy("product_name")
        order = [F.col("product_name")]
    else:
        order = [F.col("value").desc(), F.col("product_name")]
    return sales.orderBy(*order).limit(n).select(
        truncate_label(F.col("product_name"), label_width).alias("label"), "value")


@requires("category string, n long", "category")
def category_distribution(products: DataFrame, skip_empty: bool = True) -> DataFrame:
    """Products per category over a product list, count desc."""
    c = F.col("category")
    keep = c.isNotNull() & (c != "") if skip_empty else c.isNotNull()
    return (products.where(keep).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "category"))


def xy_trend(products: DataFrame, x: str, y: str = "rating") -> DataFrame:
    """(x, y) pairs with both present, ordered by x."""
    if x not in products.columns or y not in products.columns:
        return products.sparkSession.createDataFrame([], "x double, y double")
    return products.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().orderBy("x", "y")


@requires("rating double, n long", "rating")
def rating_distribution(products: DataFrame, one_decimal: bool = False) -> DataFrame:
    """Products per rating value; ``one_decimal`` groups on the rating
    rounded for display to one decimal (as text)."""
    r = F.col("rating")
    key = F.regexp_replace(F.format_number(r, 1), ",", "") if one_decimal else r
    return (products.where(r.isNotNull()).groupBy(key.alias("rating"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(
                F.col("rating").cast("double") if one_decimal else F.col("rating")))
