"""Registered queries over the driver tables and their DuckDB oracle SQL.

Every query reads the whole driver tables through the retail view (or the
``conversations`` table for questions); nothing is subset or capped except
where a limit is the feature (top-k reports, display limits, catalogue page).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators import (ask, bands, basket, catalog, category, charts, finance,
                                  ingest, metrics, models, narrate)
from shelfscope.plans import fused
from shelfscope.sources.retail_view import RETAIL_SQL, kept, line_tasks, retail_view, table, with_expenditure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if body.upper().startswith("WITH "):
                ORACLE[name] = f"WITH retail AS ({RETAIL_SQL}),\n{body[5:]}"
            else:
                ORACLE[name] = f"WITH retail AS ({RETAIL_SQL})\n{body}"
        return fn
    return wrap


# SQL spellings of the Spark helpers -------------------------------------------

def _mean(x: str) -> str:
    return (f"CAST(SUM(CAST({x} AS DECIMAL(38,6))) AS DOUBLE) "
            f"/ NULLIF(COUNT({x}), 0)")


def _sum(x: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({x} AS DECIMAL(38,6))), 0) AS DOUBLE)"


def _median(x: str, where: str = "TRUE") -> str:
    # lo + (hi - lo) * 0.5 over the two middle values, as the Spark side does
    return (f"(SELECT lo + (hi - lo) * 0.5 FROM (SELECT "
            f"MIN(CASE WHEN rn = (n + 1) // 2 THEN v END) AS lo, "
            f"MIN(CASE WHEN rn = n // 2 + 1 THEN v END) AS hi FROM ("
            f"SELECT CAST({x} AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY CAST({x} AS DOUBLE)) AS rn, "
            f"COUNT(*) OVER () AS n FROM retail WHERE {x} IS NOT NULL AND ({where}))))")


def _half_up(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ((20000 * {n} + {d}) // (2 * {d})) / 10000.0e0 END"


def _v(spark: SparkSession, sf: str) -> DataFrame:
    return retail_view(spark, sf)


# Normalisation --------------------------------------------------------------

@register("normalize_numeric", """
SELECT order_id, line_no,
  TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) AS price,
  TRY_CAST(CAST(rating AS VARCHAR) AS DOUBLE) AS rating,
  CAST(NULL AS DOUBLE) AS bad
FROM retail""")
def q_normalize_numeric(spark, sf):
    """N3 on the view written out as text (and one column of junk text)."""
    text = _v(spark, sf).select(
        "order_id", "line_no", F.col("price").cast("string").alias("price"),
        F.col("rating").cast("string").alias("rating"),
        F.concat(F.col("product_name"), F.lit("%")).alias("bad"))
    return ingest.coerce_numeric(text, ["price", "rating", "bad"])


@register("impute_median", f"""
SELECT order_id, line_no,
  COALESCE(CAST(rating AS DOUBLE), {_median('rating')}) AS rating
FROM retail""")
def q_impute_median(spark, sf):
    """NULL ratings (every 50th order) take the exact median rating."""
    return ingest.impute_median(_v(spark, sf), ["rating"]).select("order_id", "line_no", "rating")


# Filters ----------------------------------------------------------------------

@register("low_rated", """
SELECT order_id, line_no, product_name, rating FROM retail WHERE rating < 3.0""")
def q_low_rated(spark, sf):
    """F1: rows rated below 3.0."""
    return metrics.low_rated(_v(spark, sf)).select("order_id", "line_no", "product_name", "rating")


@register("discount_rating_gap", """
SELECT order_id, line_no, product_name, discount_percentage, rating FROM retail
WHERE discount_percentage > 30 AND rating < 3.5""")
def q_discount_rating_gap(spark, sf):
    """discount above 30 with rating below 3.5."""
    return metrics.discount_rating_gap(_v(spark, sf)).select(
        "order_id", "line_no", "product_name", "discount_percentage", "rating")


# Aggregates -------------------------------------------------------------------

@register("kpis", f"""
SELECT COUNT(*) AS total_products, COUNT(DISTINCT category) AS total_categories,
  {_mean('price')} AS avg_price, {_mean('discount_percentage')} AS avg_discount,
  {_mean('rating')} AS avg_rating
FROM retail""")
def q_kpis(spark, sf):
    """A1: row count, distinct categories, mean price, discount and rating."""
    return metrics.kpis(_v(spark, sf))


@register("top_categories_by_revenue", f"""
SELECT category, {_sum('price')} AS revenue FROM retail WHERE category IS NOT NULL
GROUP BY category ORDER BY revenue DESC, category LIMIT 5""")
def q_top_categories_by_revenue(spark, sf):
    """A2: five categories with the largest price total."""
    return category.category_revenue(_v(spark, sf), 5)


@register("top_categories_by_rating", f"""
SELECT category, {_mean('rating')} AS avg_rating FROM retail WHERE category IS NOT NULL
GROUP BY category ORDER BY avg_rating DESC NULLS LAST, category LIMIT 5""")
def q_top_categories_by_rating(spark, sf):
    """A3: five categories with the highest mean rating."""
    return category.category_rating(_v(spark, sf), 5)


@register("avg_price_by_category", f"""
SELECT category, {_mean('price')} AS avg_price FROM retail WHERE category IS NOT NULL
GROUP BY category ORDER BY category LIMIT 10""")
def q_avg_price_by_category(spark, sf):
    """A4: mean price of the first ten categories by name."""
    return category.avg_price_by_category(_v(spark, sf), 10)


@register("avg_discount_by_category", f"""
SELECT category, {_mean('discount_percentage')} AS avg_discount FROM retail
WHERE category IS NOT NULL GROUP BY category ORDER BY category LIMIT 10""")
def q_avg_discount_by_category(spark, sf):
    """A5: mean discount of the first ten categories by name."""
    return category.avg_discount_by_category(_v(spark, sf), 10)


_BAND_CASE = """CASE WHEN p > 0 AND p <= 500 THEN 1 WHEN p > 500 AND p <= 1000 THEN 2
  WHEN p > 1000 AND p <= 2000 THEN 3 WHEN p > 2000 AND p <= 5000 THEN 4
  WHEN p > 5000 AND p <= 10000 THEN 5 WHEN p > 10000 THEN 6 END"""


@register("price_bands", f"""
WITH b AS (SELECT {_BAND_CASE} AS band_order FROM (SELECT CAST(price AS DOUBLE) AS p FROM retail)),
dim AS (SELECT * FROM (VALUES (1, 'Budget (<500)'), (2, 'Economy (500-1000)'),
  (3, 'Standard (1000-2000)'), (4, 'Premium (2000-5000)'), (5, 'Luxury (5000-10000)'),
  (6, 'Ultra-Luxury (>10000)')) t(band_order, price_band))
SELECT CAST(dim.band_order AS INT) AS band_order, dim.price_band,
  COALESCE(c.n, 0) AS n
FROM dim LEFT JOIN (SELECT band_order, COUNT(*) AS n FROM b WHERE band_order IS NOT NULL
  GROUP BY band_order) c ON dim.band_order = c.band_order""")
def q_price_bands(spark, sf):
    """Rows per price band, all six bands listed."""
    return bands.price_bands(_v(spark, sf))


@register("high_discount_rating", f"""
SELECT CASE WHEN COUNT(*) FILTER (WHERE discount_percentage > 30) = 0 THEN 0.0e0
  ELSE {_mean('CASE WHEN discount_percentage > 30 THEN rating END')} END
  AS high_discount_avg_rating FROM retail""")
def q_high_discount_rating(spark, sf):
    """Mean rating of rows with discount above 30."""
    return metrics.high_discount_rating(_v(spark, sf))


@register("segmentation", f"""
WITH m AS (SELECT {_median('price')} AS med),
f AS (SELECT rating >= 4.0 AS hr, rating < 3.0 AS lr, CAST(price AS DOUBLE) > med AS hp,
  CAST(price AS DOUBLE) <= med AS lp FROM retail, m)
SELECT * FROM (VALUES
 ('Star Products (High Rating, High Price)', (SELECT COUNT(*) FROM f WHERE hr AND hp)),
 ('Hidden Gems (High Rating, Low Price)', (SELECT COUNT(*) FROM f WHERE hr AND lp)),
 ('Declining Products (Low Rating, High Price)', (SELECT COUNT(*) FROM f WHERE lr AND hp)),
 ('Dead Weight (Low Rating, Low Price)', (SELECT COUNT(*) FROM f WHERE lr AND lp))) t(segment, n)""")
def q_segmentation(spark, sf):
    """Four segments by rating and price against the exact median."""
    return bands.segmentation(_v(spark, sf))


_MODE_SQL = """
mode_rank AS (SELECT product_name, category,
  ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY cnt DESC, category) AS rk
  FROM (SELECT TRIM(product_name) AS product_name, category, COUNT(*) AS cnt FROM retail
        WHERE category IS NOT NULL AND product_name IS NOT NULL GROUP BY 1, 2)),
modes AS (SELECT product_name, category FROM mode_rank WHERE rk = 1)"""


@register("product_list", f"""
WITH {_MODE_SQL.strip()},
g AS (SELECT TRIM(product_name) AS product_name, {_mean('price')} AS price,
  {_sum('review_count')} AS sales, {_mean('rating')} AS rating,
  {_mean('discount_percentage')} AS discount_percentage
  FROM retail WHERE product_name IS NOT NULL GROUP BY 1)
SELECT g.product_name, g.price, g.sales, modes.category, g.rating, g.discount_percentage
FROM g LEFT JOIN modes ON g.product_name = modes.product_name""")
def q_product_list(spark, sf):
    """A9 + A10 + J1: one row per product."""
    return catalog.product_list(_v(spark, sf))


@register("product_category_mode", f"""
WITH {_MODE_SQL.strip()}
SELECT p.product_name, modes.category FROM
  (SELECT DISTINCT TRIM(product_name) AS product_name FROM retail WHERE product_name IS NOT NULL) p
  LEFT JOIN modes ON p.product_name = modes.product_name""")
def q_product_category_mode(spark, sf):
    """A10: most frequent category per product."""
    return catalog.product_category_mode(_v(spark, sf))


@register("product_sales", f"""
SELECT TRIM(product_name) AS product_name, {_sum('review_count')} AS value FROM retail
WHERE product_name IS NOT NULL GROUP BY 1""")
def q_product_sales(spark, sf):
    """Sales basis total per product."""
    return catalog.product_sales(_v(spark, sf))


@register("top_selling_products", f"""
SELECT TRIM(product_name) AS product_name, {_sum('review_count')} AS sales FROM retail
WHERE product_name IS NOT NULL GROUP BY 1 ORDER BY sales DESC, product_name LIMIT 10""")
def q_top_selling_products(spark, sf):
    """Ten products with the largest sales total."""
    return catalog.top_selling_products(_v(spark, sf), 10)


@register("profit_loss", """
WITH v AS (SELECT (COALESCE(price, 0) - COALESCE(cost_price, 0)) * COALESCE(quantity, 1) AS v
  FROM retail)
SELECT TRUE AS available,
  CAST(COALESCE(SUM(CASE WHEN v > 0 THEN v END), 0) AS DOUBLE) AS total_profit,
  CAST(COALESCE(SUM(CASE WHEN v < 0 THEN -v END), 0) AS DOUBLE) AS total_loss,
  CAST(COALESCE(SUM(v), 0) AS DOUBLE) AS net_profit,
  'Computed from price - cost_price x quantity' AS basis, CAST(NULL AS VARCHAR) AS note
FROM v""")
def q_profit_loss(spark, sf):
    """Profit, loss and net over (sell - cost) x quantity."""
    return finance.profit_loss(_v(spark, sf))


_YEARS = """SELECT CAST(year(order_date) AS INT) AS year,
  SUM(COALESCE(cost_price * quantity, 0)) AS e FROM retail
  WHERE order_date IS NOT NULL GROUP BY 1"""


@register("annual_expenditure", f"""
SELECT year, CAST(e AS DOUBLE) AS expenditure FROM ({_YEARS})""")
def q_annual_expenditure(spark, sf):
    """Spend per year (cost_price x quantity)."""
    return finance.annual_expenditure_table(with_expenditure(_v(spark, sf)))


@register("annual_expenditure_text_dates", """
SELECT CAST(year(order_date) AS INT) AS year,
  CAST(SUM(CAST(cost_price * quantity AS DECIMAL(38,6))) AS DOUBLE) AS expenditure FROM retail GROUP BY 1""")
def q_annual_expenditure_text_dates(spark, sf):
    """A13 on dates written in several ways, one way per line."""
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.S", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy", "d MMM yyyy", "yyyyMMdd"]
    way = F.pmod(F.col("line_no") + F.col("order_id"), F.lit(len(forms)))
    text = F.coalesce(*(F.when(way == k, F.date_format("order_date", f)) for k, f in enumerate(forms)))
    return finance.annual_expenditure_table(with_expenditure(_v(spark, sf)).withColumn("order_date", text))


@register("avg_annual_expenditure", f"""
SELECT COUNT(*) > 0 AS available,
  CASE WHEN COUNT(*) > 0 THEN CAST(SUM(e) AS DOUBLE) / COUNT(*) END AS average_annual_expenditure,
  CASE WHEN COUNT(*) > 0 THEN string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) END AS years,
  CASE WHEN COUNT(*) = 0 THEN 'No valid yearly expenditure data found.' END AS note
FROM ({_YEARS})""")
def q_avg_annual_expenditure(spark, sf):
    """Mean of the yearly sums with the year list."""
    return finance.avg_annual_expenditure(with_expenditure(_v(spark, sf)))


@register("best_worst_category", f"""
WITH m AS (SELECT category, {_mean('rating')} AS m FROM retail WHERE category IS NOT NULL
  GROUP BY category HAVING {_mean('rating')} IS NOT NULL)
SELECT (SELECT category FROM m ORDER BY m DESC, category LIMIT 1) AS best_category,
       (SELECT category FROM m ORDER BY m ASC, category LIMIT 1) AS worst_category
WHERE EXISTS (SELECT 1 FROM m)""")
def q_best_worst_category(spark, sf):
    """Best and worst category by mean rating."""
    return category.best_worst_category(_v(spark, sf))


@register("price_anchor", f"""
SELECT {_median('price', 'rating >= 4.0')} AS price_anchor""")
def q_price_anchor(spark, sf):
    """Exact median price of rows rated 4 or more."""
    return metrics.price_anchor(_v(spark, sf))


@register("discount_profile", f"""
SELECT {_mean('discount_percentage')} AS avg_discount,
  CAST(MAX(discount_percentage) AS DOUBLE) AS max_discount,
  CAST(MIN(discount_percentage) AS DOUBLE) AS min_discount FROM retail""")
def q_discount_profile(spark, sf):
    """Mean, max and min discount."""
    return metrics.discount_profile(_v(spark, sf))


@register("rating_profile", f"""
SELECT {_mean('rating')} AS avg_rating, CAST(MAX(rating) AS DOUBLE) AS best_rating,
  CAST(MIN(rating) AS DOUBLE) AS worst_rating FROM retail""")
def q_rating_profile(spark, sf):
    """Mean, max and min rating."""
    return metrics.rating_profile(_v(spark, sf))


@register("price_profile", f"""
SELECT {_mean('price')} AS avg_price, {_median('price')} AS median_price,
  CAST(MIN(price) AS DOUBLE) AS min_price, CAST(MAX(price) AS DOUBLE) AS max_price FROM retail""")
def q_price_profile(spark, sf):
    """Mean, exact median, min and max price."""
    return metrics.price_profile(_v(spark, sf))


@register("category_top3_rating", f"""
SELECT category, {_mean('rating')} AS avg_rating, COUNT(*) AS n FROM retail
WHERE category IS NOT NULL GROUP BY category
ORDER BY avg_rating DESC NULLS LAST, category LIMIT 3""")
def q_category_top3_rating(spark, sf):
    """Three best-rated categories with their row counts."""
    return category.category_top_rating_with_count(_v(spark, sf), 3)


@register("category_top3_revenue", f"""
SELECT category, {_sum('price')} AS revenue FROM retail WHERE category IS NOT NULL
GROUP BY category ORDER BY revenue DESC, category LIMIT 3""")
def q_category_top3_revenue(spark, sf):
    """Three categories with the largest price total."""
    return category.category_top_revenue(_v(spark, sf), 3)


@register("category_list", """
SELECT DISTINCT category FROM retail WHERE category IS NOT NULL AND category <> ''""")
def q_category_list(spark, sf):
    """distinct non-empty categories."""
    return category.category_list(_v(spark, sf))


@register("top5_by_price", """
SELECT substr(product_name, 1, 50) AS product_name, CAST(price AS DOUBLE) AS price, category
FROM retail WHERE price IS NOT NULL
ORDER BY price DESC, product_name, category NULLS LAST LIMIT 5""")
def q_top5_by_price(spark, sf):
    """The five highest-priced rows."""
    return catalog.top_by_price(_v(spark, sf), 5)


# Market basket ----------------------------------------------------------------

_BASKETS = """SELECT DISTINCT order_id AS txn, TRIM(product_name) AS item FROM retail
  WHERE order_id IS NOT NULL AND product_name IS NOT NULL"""
_PAIRS = f"""SELECT x.item AS product_a, y.item AS product_b, COUNT(*) AS count
  FROM ({_BASKETS}) x JOIN ({_BASKETS}) y ON x.txn = y.txn AND x.item < y.item GROUP BY 1, 2"""
_COUNTS = f"""SELECT item, COUNT(*) AS n FROM ({_BASKETS}) GROUP BY item"""
_RULES = f"""SELECT p.product_a, p.product_b, p.count,
  {_half_up('p.count', 't.total')} AS support,
  {_half_up('p.count', 'ca.n')} AS confidence_a_to_b,
  {_half_up('p.count', 'cb.n')} AS confidence_b_to_a
  FROM ({_PAIRS}) p JOIN ({_COUNTS}) ca ON p.product_a = ca.item
  JOIN ({_COUNTS}) cb ON p.product_b = cb.item,
  (SELECT COUNT(DISTINCT txn) AS total FROM ({_BASKETS})) t"""


@register("baskets", f"""
SELECT txn, COUNT(*) AS n_items FROM ({_BASKETS}) GROUP BY txn""")
def q_baskets(spark, sf):
    """B1: distinct items per basket."""
    return basket.basket_sizes(_v(spark, sf))


@register("item_counts", _COUNTS)
def q_item_counts(spark, sf):
    """B2: baskets holding each item."""
    return basket.item_counts(_v(spark, sf))


@register("item_pairs", _PAIRS)
def q_item_pairs(spark, sf):
    """B3 + J2: baskets holding both items of each pair."""
    return basket.item_pairs(_v(spark, sf), tasks=line_tasks(spark, sf))


@register("association_rules", _RULES)
def q_association_rules(spark, sf):
    """B4 + J3 + T4: support and confidences of every pair."""
    return basket.association_rules(_v(spark, sf), tasks=line_tasks(spark, sf))


@register("partners_by_product", f"""
WITH r AS ({_RULES}),
b AS (SELECT product_a AS product, product_b AS partner, count, support FROM r
      UNION ALL SELECT product_b, product_a, count, support FROM r)
SELECT product, partner, count, support,
  CAST(ROW_NUMBER() OVER (PARTITION BY product ORDER BY count DESC, support DESC, partner) AS INT)
  AS rank FROM b""")
def q_partners_by_product(spark, sf):
    """B5 + T5: ranked partners of each product."""
    return basket.partners_by_product(_v(spark, sf), tasks=line_tasks(spark, sf))


@register("association_meta", f"""
SELECT COUNT(DISTINCT txn) AS total_transactions, COUNT(DISTINCT item) AS unique_products,
  CASE WHEN COUNT(DISTINCT txn) = 0 THEN 'No transaction data available to compute product pairs.'
  ELSE '' END AS note FROM ({_BASKETS})""")
def q_association_meta(spark, sf):
    """Transactions, distinct products and note."""
    return basket.association_meta(_v(spark, sf))


# Catalogue, charts and cards ---------------------------------------------------

_PL = f"""{_MODE_SQL.strip()},
g AS (SELECT TRIM(product_name) AS product_name, {_mean('price')} AS price,
  {_sum('review_count')} AS sales, {_mean('rating')} AS rating,
  {_mean('discount_percentage')} AS discount_percentage
  FROM retail WHERE product_name IS NOT NULL GROUP BY 1),
pl AS (SELECT g.product_name, g.price, g.sales, modes.category, g.rating, g.discount_percentage
  FROM g LEFT JOIN modes ON g.product_name = modes.product_name)"""


def _products(spark, sf):
    return catalog.product_list(_v(spark, sf))


@register("catalog_search", f"""
WITH {_PL} SELECT * FROM pl WHERE contains(lower(product_name), 'ring')""")
def q_catalog_search(spark, sf):
    """F8: literal, case-insensitive search over the product list."""
    return catalog.search(_products(spark, sf), "RING")


@register("catalog_search_regex", f"""
WITH {_PL} SELECT * FROM pl WHERE regexp_matches(lower(product_name), '^(red|blue) b')""")
def q_catalog_search_regex(spark, sf):
    """the query as a regular expression on the lower-cased name."""
    return catalog.search(_products(spark, sf), "^(RED|blue) b", mode="regex")


@register("catalog_filter", f"""
WITH {_PL} SELECT * FROM pl WHERE category = 'Brand#1'""")
def q_catalog_filter(spark, sf):
    """products of one category."""
    return catalog.filter_category(_products(spark, sf), "Brand#1")


@register("catalog_order", f"""
WITH {_PL} SELECT product_name, price, CAST(ROW_NUMBER() OVER (ORDER BY price DESC NULLS LAST, product_name) AS BIGINT) AS position FROM pl""")
def q_catalog_order(spark, sf):
    """The place of every product in the 'price high' order."""
    return catalog.catalog_positions(_products(spark, sf), "price_high").select("product_name", "price", "position")


@register("catalog_sort_js", f"""
WITH {_PL} SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY rating ASC NULLS FIRST, product_name) AS INT)
  AS position FROM pl WHERE contains(lower(product_name), 'e')
  ORDER BY rating ASC NULLS FIRST, product_name LIMIT 15""")
def q_catalog_sort_js(spark, sf):
    """T2: 'rating low' with missing values first (browser order), searched."""
    return catalog.catalog_page(_products(spark, sf), "rating_low", 15, nulls="js", query="E")


def _register_sort_mode(mode: str) -> None:
    column, desc = catalog.SORTS[mode]
    if column == "product_name":
        order = "product_name"
    else:
        order = f"{column} {'DESC' if desc else 'ASC'} NULLS LAST, product_name"

    def run(spark, sf):
        return catalog.catalog_page(_products(spark, sf), mode, 25)

    run.__doc__ = f"T2: catalogue page of 25 in '{mode}' order."
    register(f"catalog_sort_{mode}", f"""
WITH {_PL} SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INT) AS position
FROM pl ORDER BY {order} LIMIT 25""")(run)


for _mode in catalog.SORTS:
    _register_sort_mode(_mode)


@register("chart_top_products", f"""
SELECT CASE WHEN length(product_name) > 8 THEN substr(product_name, 1, 8) || '…'
  ELSE product_name END AS label, value FROM (
  SELECT TRIM(product_name) AS product_name, {_sum('review_count')} AS value FROM retail
  WHERE product_name IS NOT NULL GROUP BY 1 ORDER BY value DESC, product_name LIMIT 20)""")
def q_chart_top_products(spark, sf):
    """C1 (+N11): 20 products by sales with labels cut at 8 characters."""
    return charts.top_products(_v(spark, sf), 20, label_width=8)


@register("chart_category_distribution", f"""
WITH {_PL} SELECT category, COUNT(*) AS n FROM pl
  WHERE category IS NOT NULL AND category <> '' GROUP BY category""")
def q_chart_category_distribution(spark, sf):
    """Products per category."""
    return charts.category_distribution(_products(spark, sf))


@register("chart_price_rating", f"""
WITH {_PL} SELECT price AS x, rating AS y FROM pl WHERE price IS NOT NULL AND rating IS NOT NULL""")
def q_chart_price_rating(spark, sf):
    """(price, rating) points of the product list."""
    return charts.xy_trend(_products(spark, sf), "price")


@register("chart_discount_rating", f"""
WITH {_PL} SELECT discount_percentage AS x, rating AS y FROM pl
  WHERE discount_percentage IS NOT NULL AND rating IS NOT NULL""")
def q_chart_discount_rating(spark, sf):
    """C4: (discount, rating) points of the product list."""
    return charts.xy_trend(_products(spark, sf), "discount_percentage")


@register("chart_rating_distribution", f"""
WITH {_PL} SELECT rating, COUNT(*) AS n FROM pl WHERE rating IS NOT NULL GROUP BY rating""")
def q_chart_rating_distribution(spark, sf):
    """Products per exact rating."""
    return charts.rating_distribution(_products(spark, sf))


@register("chart_rating_distribution_1dp", f"""
WITH {_PL} SELECT format('{{:.1f}}', rating) AS rating, COUNT(*) AS n FROM pl
  WHERE rating IS NOT NULL GROUP BY 1""")
def q_chart_rating_distribution_1dp(spark, sf):
    """Products per rating shown to one decimal."""
    return charts.rating_distribution(_products(spark, sf), one_decimal=True)


@register("bought_together_cards", f"""
WITH r AS ({_RULES}),
t AS (SELECT COUNT(DISTINCT txn) AS total FROM ({_BASKETS})),
rc AS (SELECT 'rule' AS kind,
  CAST(ROW_NUMBER() OVER (ORDER BY count DESC, support DESC, product_a, product_b) AS INT) AS position,
  product_a || ' ↔ ' || product_b AS title,
  'When customers purchase ' || product_a || ', they also purchase ' || product_b || ' in ' ||
  CAST(count AS VARCHAR) || ' out of ' || CAST(t.total AS VARCHAR) || ' transactions. This happens ' ||
  format('{{:.1f}}', confidence_a_to_b * 100) || '% of the time.' AS body,
  'Support: ' || format('{{:.1f}}', support * 100) || '% | Confidence: ' ||
  format('{{:.1f}}', confidence_a_to_b * 100) || '%' AS stats
  FROM r, t ORDER BY count DESC, support DESC, product_a, product_b LIMIT 8),
b AS (SELECT product_a AS product, product_b AS partner, count, support FROM r
      UNION ALL SELECT product_b, product_a, count, support FROM r),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY count DESC, support DESC, partner)
  AS rank FROM b),
pp AS (SELECT product, COUNT(*) AS n_partners,
  string_agg(CASE WHEN rank <= 3 THEN partner || ' (' || CAST(count AS VARCHAR) || 'x)' END, ', '
    ORDER BY rank) AS listed,
  MAX(CASE WHEN rank = 1 THEN partner END) AS top_partner,
  MAX(CASE WHEN rank = 1 THEN count END) AS top_count FROM rk GROUP BY product
  ORDER BY product LIMIT 12),
pc AS (SELECT 'product' AS kind, CAST(ROW_NUMBER() OVER (ORDER BY product) AS INT) AS position,
  product AS title,
  'Often bought with: ' || listed || '. When customers buy ' || product ||
  ', they frequently also purchase ' || top_partner || '. This occurs in ' ||
  CAST(top_count AS VARCHAR) || ' transactions.' AS body,
  CAST(n_partners AS VARCHAR) || ' complementary products identified' AS stats FROM pp)
SELECT * FROM rc UNION ALL SELECT * FROM pc""")
def q_bought_together_cards(spark, sf):
    """B8 + T6: rule cards and product cards as text."""
    return basket.bought_together_cards(_v(spark, sf), tasks=line_tasks(spark, sf))


# Models -----------------------------------------------------------------------

_U = ("CAST(CAST('0x' || substr(md5(CAST(order_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) "
      "|| ':' || CAST(part_key AS VARCHAR) || ':' || CAST(supp_key AS VARCHAR)), 1, 8) AS BIGINT) "
      "AS DOUBLE) / 4294967296.0e0")
KEY = ["order_id", "line_no", "part_key", "supp_key"]


@register("category_codes", """
SELECT category, CAST(DENSE_RANK() OVER (ORDER BY category) - 1 AS DOUBLE) AS code
FROM (SELECT DISTINCT category FROM retail WHERE category IS NOT NULL)""")
def q_category_codes(spark, sf):
    """M1: category codes by sorted order."""
    return models.category_codes(_v(spark, sf))


@register("train_test_split", f"""
SELECT CASE WHEN {_U} < 0.2 THEN 'test' ELSE 'train' END AS split, COUNT(*) AS n
FROM retail GROUP BY 1""")
def q_train_test_split(spark, sf):
    """M3: rows per side of the 80/20 split."""
    return (models.with_split(_v(spark, sf), KEY).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n")))


# the rows after median imputation, as an upload is cleaned before anything is computed
_IMPUTED_SQL = f"""
filled AS (SELECT * REPLACE (COALESCE(rating, {_median('rating')}) AS rating) FROM retail)"""


def _imputed(spark, sf):
    return ingest.impute_median(_v(spark, sf), ["rating"])


@register("synthetic_sales", f"""
WITH {_IMPUTED_SQL}
SELECT order_id, line_no, CAST(TRUNC(rating * (500.0e0 + 1500.0e0 * ({_U}))
  * (1.0e0 + discount_percentage / 100.0e0)
  * CASE WHEN price < 1000 THEN 2 ELSE 1 END) AS BIGINT) AS sales_volume FROM filled""")
def q_synthetic_sales(spark, sf):
    """M5 over every line, ratings imputed first as the whole-table step needs."""
    return models.with_synthetic_sales(_imputed(spark, sf), KEY).select("order_id", "line_no", "sales_volume")


def _uploaded(spark, sf):
    """The view as a user would upload it (other headers, numbers as text), cleaned."""
    view = _v(spark, sf)
    text = view.withColumns({c: F.col(c).cast("string") for c in ("price", "rating", "discount_percentage")})
    raw = text.withColumnsRenamed({"price": " PRICE", "rating": "Rating ", "product_name": "ProductName"})
    return ingest.normalize(raw, strict=True, impute=True)


_VOLUME_SQL = f"""{_IMPUTED_SQL},
sold AS (SELECT *, CAST(TRUNC(rating * (500.0e0 + 1500.0e0 * ({_U})) * (1.0e0 + discount_percentage / 100.0e0)
  * CASE WHEN price < 1000 THEN 2 ELSE 1 END) AS BIGINT) AS sales_volume FROM filled)"""


@register("normalized_kpis", f"""
WITH {_IMPUTED_SQL} SELECT COUNT(*) AS total_products, COUNT(DISTINCT category) AS total_categories,
  {_mean('price')} AS avg_price, {_mean('discount_percentage')} AS avg_discount, {_mean('rating')} AS avg_rating FROM filled""")
def q_normalized_kpis(spark, sf):
    """An upload is folded, aliased, coerced and imputed, then summarised."""
    return metrics.kpis(_uploaded(spark, sf))


@register("normalized_product_list", f"""
WITH {_VOLUME_SQL},
counted AS (SELECT TRIM(product_name) AS product_name, category, COUNT(*) AS n FROM sold WHERE category IS NOT NULL GROUP BY 1, 2),
best AS (SELECT product_name, category FROM counted
  QUALIFY ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY n DESC, category) = 1),
g AS (SELECT TRIM(product_name) AS product_name, {_mean('price')} AS price, CAST(SUM(sales_volume) AS DOUBLE) AS sales,
  {_mean('rating')} AS rating, {_mean('discount_percentage')} AS discount_percentage FROM sold GROUP BY 1)
SELECT g.product_name, price, sales, category, rating, discount_percentage FROM g LEFT JOIN best USING (product_name)""")
def q_normalized_product_list(spark, sf):
    """The catalogue of a cleaned upload, with the synthetic volume as its sales."""
    return catalog.product_list(models.with_synthetic_sales(_uploaded(spark, sf), KEY))


@register("normalized_explanation", """
SELECT * FROM (VALUES
 (1, 'How suggestions are generated:'),
 (2, '• Ratings: We flag low-rated products (<3.0) because they usually drive returns or poor reviews.'),
 (3, '• Discounts vs Ratings: High discounts with low ratings often indicate quality or expectation gaps.'),
 (4, '• Price Anchor: We find the median price of high-rated products to suggest a strong pricing band.'),
 (5, '• Category Performance: We compare average ratings per category to spot winners and underperformers.'),
 (6, '• Top sellers are derived from the synthetic sales volume model based on rating, price, and discount.'))
 t(position, line)""")
def q_normalized_explanation(spark, sf):
    """R2, M7: after imputation the basis is the synthetic volume."""
    return narrate.insights_explanation(_uploaded(spark, sf))


@register("model_features", f"""
WITH m AS (SELECT {_mean('rating')} AS mr, {_mean('price')} AS mp,
  {_mean('discount_percentage')} AS md FROM retail),
codes AS (SELECT category, CAST(DENSE_RANK() OVER (ORDER BY category) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT category FROM retail WHERE category IS NOT NULL)),
k AS (SELECT CAST(COUNT(*) AS DOUBLE) AS k FROM codes)
SELECT r.order_id, r.line_no, COALESCE(CAST(r.price AS DOUBLE), m.mp) AS price,
  COALESCE(r.discount_percentage, m.md) AS discount_percentage,
  COALESCE(codes.code, k.k) AS category_code, COALESCE(r.rating, m.mr) AS rating,
  CASE WHEN {_U} < 0.2 THEN 'test' ELSE 'train' END AS split
FROM retail r CROSS JOIN m CROSS JOIN k LEFT JOIN codes ON r.category = codes.category""")
def q_model_features(spark, sf):
    """M1-M3: the feature table the rating model trains on (mean fills, codes, split)."""
    return models.rating_features(_v(spark, sf), KEY).select(
        "order_id", "line_no", "price", "discount_percentage", "category_code", "rating", "split")


#: The forests of the registered runs: as many trees as the original grows. The depth bounds
#: the size of a tree (at most 2**depth leaves), since MLlib keeps whole levels on the driver.
MODEL_TREES, MODEL_DEPTH = 100, 8


def _model_view(spark, sf):
    """What the models read of the view, kept: its joins are run once for a median, the means and the forest."""
    return kept(_v(spark, sf).select(*KEY, "category", "price", "discount_percentage", "rating"))


@register("rating_model")
def q_rating_model(spark, sf):
    """M4 over every line (scores of a trained model: rows-only check)."""
    with _model_view(spark, sf) as view:
        return _rating_scores(view)


def _rating_scores(view):
    return models.rating_model(view, MODEL_TREES, MODEL_DEPTH, KEY, keep=False).metrics


@register("sales_model")
def q_sales_model(spark, sf):
    """M6 on the synthetic volume of every line (rows-only check)."""
    with _model_view(spark, sf) as view:
        return _sales_scores(_with_sales(view))


def _with_sales(view):
    return models.with_synthetic_sales(ingest.impute_median(view, ["rating"]), KEY)


def _sales_scores(data):
    return models.sales_model(data, MODEL_TREES, MODEL_DEPTH, KEY, keep=False).metrics


def _checked(metrics):
    """Whether a model's scores keep the bounds that any model must keep."""
    cols = metrics.columns
    low = F.col("mae") <= F.col("rmse") + 1e-12 if "mae" in cols else F.lit(True)
    return metrics.select((F.col("rmse") >= 0).alias("rmse_ok"), low.alias("mae_ok"), (F.col("r2") <= 1).alias("r2_ok"))


_TEST_ROWS = f"SELECT COUNT(*) FROM retail WHERE {_U} < 0.2"


@register("rating_model_bounds", f"""
SELECT TRUE AS rmse_ok, TRUE AS mae_ok, TRUE AS r2_ok, ({_TEST_ROWS}) AS test_rows""")
def q_rating_model_bounds(spark, sf):
    """M3, M4: size of the test part, and bounds that the scores of the registered forest keep."""
    with _model_view(spark, sf) as view:
        rows = models.with_split(view, KEY).where("split = 'test'").count()
        return _checked(_rating_scores(view)).withColumn("test_rows", F.lit(rows).cast("long"))


@register("sales_model_bounds", f"""
SELECT TRUE AS rmse_ok, TRUE AS mae_ok, TRUE AS r2_ok, ({_TEST_ROWS}) AS test_rows""")
def q_sales_model_bounds(spark, sf):
    """M3, M6: size of the test part, and bounds that the scores of the registered forest keep."""
    with _model_view(spark, sf) as view:
        data = _with_sales(view)
        rows = models.with_split(data, KEY).where("split = 'test' AND sales_volume IS NOT NULL").count()
        return _checked(_sales_scores(data)).withColumn("test_rows", F.lit(rows).cast("long"))


# Text ---------------------------------------------------------------------------

def _fmt0(x: str) -> str:
    return f"'₹' || format('{{:,.0f}}', {x})"


def _fmt1(x: str) -> str:
    return f"format('{{:.1f}}', {x})"


_METRICS = f"""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT category) AS n_categories,
  {_mean('price')} AS avg_price, CAST(MIN(price) AS DOUBLE) AS min_price,
  CAST(MAX(price) AS DOUBLE) AS max_price, {_mean('rating')} AS avg_rating,
  {_mean('discount_percentage')} AS avg_discount,
  COUNT(*) FILTER (WHERE rating < 3.0) AS n_low,
  COUNT(*) FILTER (WHERE discount_percentage > 30 AND rating < 3.5) AS n_gap,
  COUNT(*) FILTER (WHERE rating >= 4.0) AS n_high,
  COUNT(*) FILTER (WHERE rating IS NULL OR discount_percentage IS NULL) AS n_incomplete
  FROM retail"""
_BW = f"""SELECT category, {_mean('rating')} AS m FROM retail WHERE category IS NOT NULL
  GROUP BY category HAVING {_mean('rating')} IS NOT NULL"""


@register("recommendations", f"""
WITH m AS ({_METRICS}), bw AS ({_BW}),
l AS (SELECT 1 AS k, CASE WHEN n_low > 0 THEN CAST(n_low AS VARCHAR) ||
    ' products have low ratings (<3.0). Improve quality, listings, or consider discontinuation.' END AS line FROM m
  UNION ALL SELECT 2, CASE WHEN n_gap > 0 THEN CAST(n_gap AS VARCHAR) ||
    ' products have high discount but low rating. Review quality or positioning.' END FROM m
  UNION ALL SELECT 3, CASE WHEN n_high > 0 THEN 'Price anchor: high-rated products cluster around ' ||
    {_fmt0(_median('price', 'rating >= 4.0'))} || '. Keep new launches near this band.' END FROM m
  UNION ALL SELECT 4, 'Best performing category: ' || (SELECT category FROM bw ORDER BY m DESC, category LIMIT 1)
  UNION ALL SELECT 5, 'Category needing improvement: ' || (SELECT category FROM bw ORDER BY m, category LIMIT 1)
  UNION ALL SELECT 6, 'Top sellers are based on ' ||
    CASE WHEN n_incomplete = 0 THEN 'sales_volume' ELSE 'review_count' END ||
    '. Use these items for bundles, ads, and cross-sell placement.' FROM m)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY k) AS INT) AS position, line FROM l WHERE line IS NOT NULL""")
def q_recommendations(spark, sf):
    """Ordered recommendation lines."""
    return narrate.recommendations(_v(spark, sf))


@register("insights_explanation", """
WITH m AS (SELECT COUNT(*) FILTER (WHERE rating IS NULL OR discount_percentage IS NULL) AS n_incomplete
  FROM retail)
SELECT * FROM (VALUES
 (1, 'How suggestions are generated:'),
 (2, '• Ratings: We flag low-rated products (<3.0) because they usually drive returns or poor reviews.'),
 (3, '• Discounts vs Ratings: High discounts with low ratings often indicate quality or expectation gaps.'),
 (4, '• Price Anchor: We find the median price of high-rated products to suggest a strong pricing band.'),
 (5, '• Category Performance: We compare average ratings per category to spot winners and underperformers.'))
 t(position, line)
UNION ALL SELECT 6, CASE WHEN n_incomplete = 0
  THEN '• Top sellers are derived from the synthetic sales volume model based on rating, price, and discount.'
  ELSE '• Top sellers are inferred from review counts (as a proxy for demand).' END FROM m""")
def q_insights_explanation(spark, sf):
    """R2: the explanation lines for the table's sales basis."""
    return narrate.insights_explanation(_v(spark, sf))


_OVERVIEW = f"""SELECT 'Data Overview: ' || CAST(n_rows AS VARCHAR) || ' products analyzed' || chr(10) ||
  'Categories: ' || CAST(n_categories AS VARCHAR) || ' unique categories' || chr(10) ||
  'Price Range: ' || {_fmt0('min_price')} || ' - ' || {_fmt0('max_price')} || chr(10) ||
  'Average Price: ' || {_fmt0('avg_price')} || chr(10) ||
  'Average Rating: ' || {_fmt1('avg_rating')} || '/5' || chr(10) ||
  'Average Discount: ' || {_fmt1('avg_discount')} || '%' AS text FROM m"""


@register("general_insights", f"""
WITH m AS ({_METRICS}) {_OVERVIEW}""")
def q_general_insights(spark, sf):
    """The data overview text."""
    return narrate.general_insights(_v(spark, sf))


def _user_turns(spark, sf):
    """Questions: every user turn of the conversations table, whole text."""
    conv = table(spark, sf, "conversations")
    return conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))


def _intent_sql(q: str) -> str:
    parts = [f"WHEN regexp_replace(COALESCE({q}, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'empty'"]
    for intent, phrase, _ in ask.CONCEPTS:
        parts.append(f"WHEN contains(lower({q}), '{phrase}') THEN '{intent}'")
    for intent, words in ask.ROUTES:
        cond = " OR ".join(f"contains(lower({q}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{intent}'")
    return "CASE " + " ".join(parts) + " ELSE 'overview' END"


@register("question_intents", f"""
SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations WHERE role = 'user'""")
def q_question_intents(spark, sf):
    """Q1 over every user turn of the conversations table."""
    turns = _user_turns(spark, sf)
    return turns.select("conv_id", "turn", ask.intent_of(F.col("question")).alias("intent"))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _answers_sql() -> str:
    concept_rows = " UNION ALL ".join(
        f"SELECT {_lit(i)} AS intent, {_lit(t)} AS answer" for i, _, t in ask.CONCEPTS if t)
    nl = "chr(10)"
    return f"""
am AS (SELECT COUNT(*) AS n_rows, COUNT(DISTINCT category) AS n_categories,
  {_mean('price')} AS avg_price, CAST(MIN(price) AS DOUBLE) AS min_price,
  CAST(MAX(price) AS DOUBLE) AS max_price, {_mean('rating')} AS avg_rating,
  CAST(MIN(rating) AS DOUBLE) AS min_rating, CAST(MAX(rating) AS DOUBLE) AS max_rating,
  {_mean('discount_percentage')} AS avg_discount,
  CAST(MIN(discount_percentage) AS DOUBLE) AS min_discount,
  CAST(MAX(discount_percentage) AS DOUBLE) AS max_discount FROM retail),
m AS (SELECT * FROM am),
t5 AS (SELECT substr(product_name, 1, 50) AS product_name, CAST(price AS DOUBLE) AS price, category
  FROM retail WHERE price IS NOT NULL ORDER BY price DESC, product_name, category NULLS LAST LIMIT 5),
c3 AS (SELECT category, {_mean('rating')} AS avg_rating, COUNT(*) AS n FROM retail
  WHERE category IS NOT NULL GROUP BY category ORDER BY avg_rating DESC NULLS LAST, category LIMIT 3),
r3 AS (SELECT category, {_sum('price')} AS revenue FROM retail WHERE category IS NOT NULL
  GROUP BY category ORDER BY revenue DESC, category LIMIT 3),
ru AS (SELECT * FROM ({_RULES}) ORDER BY count DESC, support DESC, product_a, product_b LIMIT 10),
answers AS (
  {concept_rows}
  UNION ALL SELECT 'concept_average_price', 'Average price is ' || {_fmt0('avg_price')} || '.' FROM am
  UNION ALL SELECT 'top_products', {_lit('Top 5 Products by Price:' + chr(10) * 2)} ||
    (SELECT string_agg('• ' || product_name || {nl} || '  Price: ' || {_fmt0('price')} || ' | Category: '
      || COALESCE(category, 'nan') || {nl} || {nl}, '' ORDER BY price DESC, product_name,
      category NULLS LAST) FROM t5)
  UNION ALL SELECT 'category_rating', {_lit('Best Performing Categories:' + chr(10) * 2)} ||
    (SELECT string_agg('• ' || category || ': ' || {_fmt1('avg_rating')} || ' stars ('
      || CAST(n AS VARCHAR) || ' products)' || {nl}, '' ORDER BY avg_rating DESC NULLS LAST, category)
     FROM c3)
  UNION ALL SELECT 'revenue', {_lit('Top Revenue Categories:' + chr(10) * 2)} ||
    (SELECT string_agg('• ' || category || ': ' || {_fmt0('revenue')} || {nl}, ''
      ORDER BY revenue DESC, category) FROM r3)
  UNION ALL SELECT 'discount', {_lit('Discount Insights:' + chr(10) * 2 + '• Average Discount: ')} ||
    {_fmt1('avg_discount')} || '%' || {nl} || '• Maximum Discount: ' || {_fmt1('max_discount')} || '%'
    || {nl} || '• Minimum Discount: ' || {_fmt1('min_discount')} || '%' FROM am
  UNION ALL SELECT 'rating', {_lit('Rating Insights:' + chr(10) * 2 + '• Average Rating: ')} ||
    {_fmt1('avg_rating')} || '/5' || {nl} || '• Best Rating: ' || {_fmt1('max_rating')} || '/5'
    || {nl} || '• Lowest Rating: ' || {_fmt1('min_rating')} || '/5' FROM am
  UNION ALL SELECT 'count', 'Total Products: ' || format('{{:,}}', n_rows) FROM am
  UNION ALL SELECT 'price', {_lit('Price Insights:' + chr(10) * 2 + '• Average Price: ')} ||
    {_fmt0('avg_price')} || {nl} || '• Median Price: ' || {_fmt0(_median('price'))} || {nl} ||
    '• Price Range: ' || {_fmt0('min_price')} || ' - ' || {_fmt0('max_price')} FROM am
  UNION ALL SELECT 'associations', COALESCE(
    {_lit('Top Product Pairs (sold together):' + chr(10) * 2)} ||
    (SELECT string_agg('• ' || product_a || ' + ' || product_b || ' (Count: ' || CAST(count AS VARCHAR)
      || ', Support: ' || format('{{:.2f}}', support * 100) || '%)' || {nl}, ''
      ORDER BY count DESC, support DESC, product_a, product_b) FROM ru),
    {_lit('Product Associations:' + chr(10) * 2 + basket.NO_DATA)})
  UNION ALL SELECT 'overview', text FROM ({_OVERVIEW})
  UNION ALL SELECT 'empty', {_lit(ask.EMPTY_ANSWER)})"""


@register("answer_questions", f"""
WITH {_answers_sql().strip()}
SELECT conv_id, turn, q.intent, answers.answer FROM
  (SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations WHERE role = 'user') q
  LEFT JOIN answers ON q.intent = answers.intent""")
def q_answer_questions(spark, sf):
    """Q2: each user turn answered from the retail view."""
    routed = _user_turns(spark, sf).withColumn("intent", ask.intent_of(F.col("question")))
    answers = ask.answer_table(_v(spark, sf), ask.asked_intents(routed), line_tasks(spark, sf))
    return (routed.join(F.broadcast(answers), "intent", "left")
            .select("conv_id", "turn", "intent", "answer"))


@register("answer_table", f"""
WITH {_answers_sql().strip()}
SELECT intent, answer FROM answers""")
def q_answer_table(spark, sf):
    """Q2: the answer of every intent, from the whole retail view, whose joins are run once."""
    with kept(_v(spark, sf).select("order_id", "product_name", "category", "price", "discount_percentage", "rating")) as view:
        answers = ask.answer_table(view, tasks=line_tasks(spark, sf))
        return spark.createDataFrame(answers.collect(), answers.schema)  # a row for each intent


# Whole analysis and corner cases ------------------------------------------------

_LONG = " UNION ALL ".join(
    f"SELECT '{name}' AS insight, {label} AS label, '{figure}' AS figure, CAST({figure} AS DOUBLE) AS value FROM ({ORACLE[name]})"
    for name, label, figures in (
        ("avg_discount_by_category", "category", ["avg_discount"]), ("avg_price_by_category", "category", ["avg_price"]),
        ("category_top3_rating", "category", ["avg_rating", "n"]), ("category_top3_revenue", "category", ["revenue"]),
        ("discount_profile", "''", ["avg_discount", "max_discount", "min_discount"]),
        ("high_discount_rating", "''", ["high_discount_avg_rating"]),
        ("kpis", "''", ["total_products", "total_categories", "avg_price", "avg_discount", "avg_rating"]),
        ("price_bands", "price_band", ["n"]), ("price_profile", "''", ["avg_price", "median_price", "min_price", "max_price"]),
        ("rating_profile", "''", ["avg_rating", "best_rating", "worst_rating"]), ("segmentation", "segment", ["n"]),
        ("top_categories_by_rating", "category", ["avg_rating"]), ("top_categories_by_revenue", "category", ["revenue"]))
    for figure in figures)


@register("fused_analysis", _LONG)
def q_fused_analysis(spark, sf):
    """A1-A8 and A16-A20 of the whole view from one aggregate by category and band."""
    return fused.long_table(fused.FusedFigures(_v(spark, sf)).insights())


@register("impute_median_or_zero", f"""
SELECT order_id, line_no, COALESCE(CAST(rating AS DOUBLE), {_median('rating')}) AS rating, 0.0e0 AS empty FROM retail""")
def q_impute_median_or_zero(spark, sf):
    """A column without any value takes zero, another one its median."""
    data = _v(spark, sf).withColumn("empty", F.when(F.col("rating") < 0, F.col("rating")))
    return ingest.impute_median(data, ["rating", "empty"], all_null_fill=0.0).select("order_id", "line_no", "rating", "empty")


@register("association_notes", f"""
SELECT 'all' AS lines, COUNT(DISTINCT order_id) AS total_transactions, COUNT(DISTINCT TRIM(product_name)) AS unique_products, '' AS note FROM retail
UNION ALL SELECT 'no order', 0, 0, '{basket.NO_DATA}'
UNION ALL SELECT 'no product column', 0, 0, '{basket.NO_PRODUCT}'""")
def q_association_notes(spark, sf):
    """The note on all lines, on lines without an order, and without a product column."""
    view = _v(spark, sf)
    unknown = view.withColumn("order_id", F.when(F.col("line_no") < 0, F.col("order_id")))
    parts = [basket.association_meta(df).withColumn("lines", F.lit(name)) for name, df in (
        ("all", view), ("no order", unknown), ("no product column", view.drop("product_name")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("blank_questions", f"""
SELECT conv_id, turn, 'empty' AS intent, '{ask.EMPTY_ANSWER}' AS answer FROM conversations WHERE role = 'user'""")
def q_blank_questions(spark, sf):
    """Q3: every user turn with white space in place of its characters."""
    blank = _user_turns(spark, sf).withColumn("question", F.regexp_replace("question", r"\S", " "))
    routed = blank.withColumn("intent", ask.intent_of(F.col("question")))
    answers = ask.answer_table(_v(spark, sf), ask.asked_intents(routed), line_tasks(spark, sf))
    return routed.join(F.broadcast(answers), "intent", "left").select("conv_id", "turn", "intent", "answer")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
