"""Product roll-up, sales series and catalogue views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import exact
from shelfscope.functions.ranking import range_ranked
from shelfscope.functions.text import clean_item
from shelfscope.operators import schema
from shelfscope.operators.schema import requires


def sales_basis(df: DataFrame) -> str:
    """M7: ``sales_volume``, else ``review_count``, else ``unavailable``; without a
    product column there are no sellers to rank, so it is ``unavailable`` too."""
    if schema.resolve(df, schema.PRODUCT) is None:
        return "unavailable"
    return schema.resolve(df, schema.SALES) or "unavailable"


def _products(df: DataFrame, product: str) -> DataFrame:
    name = clean_item(F.col(product))
    # a missing name is dropped, not turned into the text "nan"
    return df.where(F.col(product).isNotNull()).withColumn("product_name", name)


def product_list(df: DataFrame) -> DataFrame:
    """A9 (+A10, J1): one row per trimmed product name, sorted by name.

    Columns: product_name, then whichever of price (mean), sales (sum of the
    sales basis), category (most frequent; ties -> smallest), rating (mean),
    discount_percentage (mean) the input supports. Rows are first aggregated by
    (product, category), where all buffers are fixed-size, and those few rows are
    merged per product.
    """
    product = schema.resolve(df, schema.PRODUCT)
    if product is None:
        return df.sparkSession.createDataFrame([], "product_name string")
    price, sales = schema.resolve(df, schema.PRICE), schema.resolve(df, schema.SALES)
    has_category = "category" in df.columns
    figures: list[exact.Figure] = []
    if price:
        figures.append(exact.mean(df, price, "price"))
    if sales:
        figures.append(exact.total(df, sales, "sales", default=0.0))
    for column in ("rating", "discount_percentage"):
        if column in df.columns:
            figures.append(exact.mean(df, column, column))
    base = _products(df, product)
    if not has_category:
        if not figures:
            return base.select("product_name").distinct().orderBy("product_name")
        return exact.aggregate(base, ["product_name"], figures).orderBy("product_name")
    rows = exact.states(base, ["product_name", "category"], [exact.count("n"), *figures]).withColumnRenamed("_n", "n")
    made = exact.finished(exact.merged(rows, ["product_name"], figures, _most_frequent()), ["product_name"], figures, "category")
    order = [c for c in ("product_name", "price", "sales", "category", "rating", "discount_percentage") if c in made.columns]
    return made.select(*order).orderBy("product_name")


def _most_frequent() -> Column:
    """Category with the most rows from rows (category, n); ties -> smallest, NULL only if all are."""
    ranked = F.struct((-F.col("n")).alias("k"), F.col("category").alias("category"))
    return F.min(F.when(F.col("category").isNotNull(), ranked))["category"].alias("category")


@requires("product_name string, category string", schema.PRODUCT, "category")
def product_category_mode(df: DataFrame) -> DataFrame:
    """A10: most frequent non-null category per product (ties -> smallest; all NULL -> NULL)."""
    product = schema.resolve(df, schema.PRODUCT)
    return (_products(df, product).groupBy("product_name", "category").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("product_name").agg(_most_frequent()))


def product_sales(df: DataFrame) -> DataFrame:
    """Total of the sales basis per product, largest first."""
    product = schema.resolve(df, schema.PRODUCT)
    sales = schema.resolve(df, schema.SALES)
    if product is None or sales is None:
        return df.sparkSession.createDataFrame([], "product_name string, value double")
    return (exact.aggregate(_products(df, product), ["product_name"], [exact.total(df, sales, "value", default=0.0)])
            .orderBy(F.col("value").desc(), "product_name"))


def top_selling_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The n products with the largest sales total (name breaks ties)."""
    return (product_sales(df).select("product_name", F.col("value").alias("sales"))
            .orderBy(F.col("sales").desc(), "product_name").limit(n))


def top_by_price(df: DataFrame, n: int = 5) -> DataFrame:
    """The n rows with the largest price, with name (first 50 chars) and category."""
    price = schema.resolve(df, ["price"])
    product = "product_name" if "product_name" in df.columns else None
    if price is None or product is None:
        return df.sparkSession.createDataFrame([], "product_name string, price double, category string")
    cat = F.col("category") if "category" in df.columns else F.lit(None).cast("string")
    return (df.where(F.col(price).isNotNull())
            .select(F.substring(F.col(product).cast("string"), 1, 50).alias("product_name"),
                    F.col(price).cast("double").alias("price"), cat.alias("category"))
            .orderBy(F.col("price").desc(), "product_name", F.col("category").asc_nulls_last())
            .limit(n))


# Catalogue views over a product list (F8-F10, T2) -------------------------

def search(products: DataFrame, query: str, mode: str = "substring") -> DataFrame:
    """F8 (``substring``: literal, case-insensitive) or F9 (``regex``: the
    lower-cased query as a pattern on the lower-cased name). Empty matches all."""
    if not query:
        return products
    name = F.lower(F.col("product_name"))
    if mode == "regex":
        return products.where(name.rlike(query.lower()))
    return products.where(name.contains(query.lower()))


def filter_category(products: DataFrame, category: str | None) -> DataFrame:
    """equality on category; ``All``/``all``/None keeps every row."""
    if category is None or category in ("All", "all"):
        return products
    return products.where(F.col("category") == category)


# Sort modes -> (column, descending).
SORTS = {
    "name": ("product_name", False),
    "price_high": ("price", True), "price_low": ("price", False),
    "rating_high": ("rating", True), "rating_low": ("rating", False),
    "discount_high": ("discount_percentage", True), "discount_low": ("discount_percentage", False),
    "sales_high": ("sales", True), "sales_low": ("sales", False),
}


def sort_columns(products: DataFrame, mode: str = "name", nulls: str = "last") -> list[Column]:
    """Sort keys for a mode. ``nulls='last'``: missing values last both ways;
    ``nulls='js'``: missing counts as -infinity (first ascending, last descending).
    The name is always the final key so the order is total."""
    column, desc = SORTS.get(mode, SORTS["name"])
    if column not in products.columns:
        column, desc = "product_name", False
    c = F.col(column)
    if column == "product_name":
        return [c.asc()]
    if desc:
        key = c.desc_nulls_last()
    else:
        key = c.asc_nulls_first() if nulls == "js" else c.asc_nulls_last()
    return [key, F.col("product_name").asc()]


def catalog_page(products: DataFrame, mode: str = "name", n: int = 20, nulls: str = "last",
                 query: str = "", search_mode: str = "substring",
                 category: str | None = None) -> DataFrame:
    """Search, filter, sort and take the first n rows, numbered from 1."""
    view = filter_category(search(products, query, search_mode), category)
    keys = sort_columns(view, mode, nulls)
    top = view.orderBy(*keys).limit(n)
    # numbering happens after the limit: at most n rows meet in one task
    return top.withColumn("position", F.row_number().over(Window.orderBy(*keys)))


def catalog_positions(products: DataFrame, mode: str = "name", nulls: str = "last") -> DataFrame:
    """Every product with its place (from 1) in the order of a mode.

    Rows are ranked over ranges of (value, name), so the products of one value, or all
    without one, spread over as many tasks as their names need. Names are distinct, so
    the order is total.
    """
    column, desc = SORTS.get(mode, SORTS["name"])
    order: list[Column] = [F.col("product_name")]
    if column in products.columns and column != "product_name":
        value = F.col(column)
        missing_first = nulls == "js" and not desc
        order = [value.isNotNull() if missing_first else value.isNull(), -value if desc else value, *order]
    # the whole row is part of the key, after what orders it
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.struct(*products.columns).alias("row"))
    ranked = range_ranked(products.select(key.alias("key")), "key")
    return ranked.select("key.row.*", (F.col("start") + 1).cast("long").alias("position"))
