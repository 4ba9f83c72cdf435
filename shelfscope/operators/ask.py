"""Q1-Q3: keyword routing of questions and their answers.

Questions arrive as a DataFrame (any size, batch or streaming). Routing is a
per-row ``CASE`` over lower-cased substring tests. Answers are computed once
per intent from the data table into a small table (one row per intent, a
fixed bound) and broadcast-joined to the questions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import exact
from shelfscope.functions.text import fmt_grouped, fmt_plain, money, percent, py_strip
from shelfscope.operators import basket, catalog, metrics, narrate

# Routing rules in order (first hit wins) and concept answers.
CONCEPTS = [
    ("concept_market_basket", "what is market basket",
     "Market basket means products people buy together in one order."),
    ("concept_association_rule", "what is association rule",
     "Association rules are simple links that show which products are often bought together."),
    ("concept_sales_volume", "what is sales volume",
     "Sales volume means how many units of a product are sold."),
    ("concept_top_sellers", "how do you decide top sellers",
     "Top sellers are chosen by the strongest sales signal available (sales volume or review count)."),
    ("concept_profit", "how do you calculate profit",
     "Profit is selling price minus cost price, multiplied by quantity sold."),
    ("concept_category", "what is a category",
     "A category is a group of similar products, like Electronics or Shoes."),
    ("concept_average_price", "what is average price", None),
    ("concept_discount", "what is discount percentage",
     "Discount percentage tells you how much price is reduced compared to the original price."),
    ("concept_rating", "what is rating",
     "Rating is the average score given by customers, usually out of 5."),
]
ROUTES = [
    ("top_products", ["best selling", "top product", "most sold"]),
    ("category_rating", ["which category", "best category", "top category"]),
    ("revenue", ["revenue", "highest revenue", "top revenue"]),
    ("discount", ["discount"]),
    ("rating", ["rating"]),
    ("count", ["how many", "total products", "count"]),
    ("price", ["price", "cost"]),
    ("associations", ["association", "sold with", "bought with", "together"]),
]
EMPTY_ANSWER = "No question provided"
INTENTS = ([i for i, _, _ in CONCEPTS] + [i for i, _ in ROUTES] + ["overview", "empty"])
MISSING_TEXT = "nan"
NO_VALUES = "No values to answer this from."
NOT_AVAILABLE = {
    "concept_average_price": "Average price is not available.",
    "top_products": "Price data not available.",
    "category_rating": "Category or rating data not available.",
    "revenue": "Revenue data not available.",
    "discount": "Discount data not available.",
    "rating": "Rating data not available.",
    "price": "Price data not available.",
}


def intent_of(question: Column) -> Column:
    """Q1 (+Q3): the routed intent of a question text."""
    q = F.lower(question)
    expr = F.when(py_strip(F.coalesce(question, F.lit(""))) == "", F.lit("empty"))
    for intent, phrase, _ in CONCEPTS:
        expr = expr.when(q.contains(phrase), F.lit(intent))
    for intent, words in ROUTES:
        hit = q.contains(words[0])
        for w in words[1:]:
            hit = hit | q.contains(w)
        expr = expr.when(hit, F.lit(intent))
    return expr.otherwise(F.lit("overview"))


def question_intents(questions: DataFrame, text_col: str = "question") -> DataFrame:
    return questions.select(F.col(text_col).alias("question"),
                            intent_of(F.col(text_col)).alias("intent"))


def _bullets(frame: DataFrame, order: list[Column], line: Column, n: int) -> Column:
    """Scalar: the first n rows of ``frame`` in ``order`` rendered and joined."""
    top = frame.orderBy(*order).limit(n)
    # numbered after the limit: the window sees at most n rows
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("i"), line.alias("t"))
    return ranked.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))),
                                               lambda e: e["t"]), "")).scalar()


def _shown(column: str) -> Column:
    """Text of a cell; a missing one as the original prints it."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_TEXT))


def _told(answer: Column, intent: str) -> Column:
    """An answer is always text: a figure of a column without values is not available."""
    return F.coalesce(answer, F.lit(NOT_AVAILABLE.get(intent, NO_VALUES)))


def answer_table(df: DataFrame, intents: Iterable[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Q2: one row per intent with its answer text, computed from ``df``; ``tasks`` as in ``basket``.

    With ``intents`` only those answers are built (and only the scans they need
    run), as each question is answered on demand in the original."""
    cols = df.columns
    has_price_col = "price" in cols
    asked = None if intents is None else set(intents)
    wanted = [k for k in INTENTS if asked is None or k in asked]
    if not wanted:
        return df.sparkSession.createDataFrame([], "intent string, answer string")
    m = metrics.metrics_row(df, with_medians="price" in wanted)

    def per_category() -> DataFrame:
        # one per-category aggregate feeds both category answers (its exchange is reused)
        none = F.lit(None).cast("double")
        return exact.aggregate(df.where(F.col("category").isNotNull()), ["category"], [
            exact.mean(df, "rating", "avg_rating") if "rating" in cols else exact.fixed(none, "avg_rating"),
            exact.count("n"),
            exact.total(df, "price", "revenue", default=0.0) if has_price_col else exact.fixed(none, "revenue")])

    def top_products() -> Column:
        if has_price_col and "product_name" in cols:
            line = F.concat(F.lit("• "), _shown("product_name"), F.lit("\n  Price: "),
                            money(F.col("price")), F.lit(" | Category: "),
                            _shown("category"), F.lit("\n\n"))
            body = _bullets(catalog.top_by_price(df, 5), [F.col("price").desc(), F.col("product_name"),
                                                         F.col("category").asc_nulls_last()], line, 5)
            return F.concat(F.lit("Top 5 Products by Price:\n\n"), body)
        if has_price_col:
            return F.concat(F.lit("Price range: "), money(F.col("min_price")), F.lit(" - "),
                            money(F.col("max_price")), F.lit("\nAverage Price: "),
                            money(F.col("avg_price")))
        return F.lit(NOT_AVAILABLE["top_products"])

    def category_rating() -> Column:
        if "category" not in cols or "rating" not in cols:
            return F.lit(NOT_AVAILABLE["category_rating"])
        line = F.concat(F.lit("• "), F.col("category"), F.lit(": "), fmt_plain(F.col("avg_rating"), 1),
                        F.lit(" stars ("), F.col("n").cast("string"), F.lit(" products)\n"))
        body = _bullets(per_category(), [F.col("avg_rating").desc_nulls_last(), F.col("category")],
                        line, 3)
        return F.concat(F.lit("Best Performing Categories:\n\n"), body)

    def revenue() -> Column:
        if "category" not in cols or not has_price_col:
            return F.lit(NOT_AVAILABLE["revenue"])
        line = F.concat(F.lit("• "), F.col("category"), F.lit(": "), money(F.col("revenue")), F.lit("\n"))
        body = _bullets(per_category(), [F.col("revenue").desc(), F.col("category")], line, 3)
        return F.concat(F.lit("Top Revenue Categories:\n\n"), body)

    def profile(intent: str, column: str, head: str, rows: list[tuple[str, str, str]]) -> Column:
        if column not in cols:
            return F.lit(NOT_AVAILABLE[intent])
        parts: list[Column] = [F.lit(head)]
        for i, (label, metric, unit) in enumerate(rows):
            parts += [F.lit(("\n" if i else "") + f"• {label}: "), fmt_plain(F.col(metric), 1), F.lit(unit)]
        return F.concat(*parts)

    def price() -> Column:
        if "price" not in cols and "selling_price" not in cols:
            return F.lit(NOT_AVAILABLE["price"])
        return F.concat(
            F.lit("Price Insights:\n\n• Average Price: "), money(F.col("avg_price")),
            F.lit("\n• Median Price: "), money(F.col("median_price")),
            F.lit("\n• Price Range: "), money(F.col("min_price")), F.lit(" - "),
            money(F.col("max_price")))

    builders = {intent: (lambda t=text: F.lit(t)) for intent, _, text in CONCEPTS if text}
    builders.update({
        "concept_average_price": lambda: (
            F.concat(F.lit("Average price is "), money(F.col("avg_price")), F.lit("."))
            if has_price_col else F.lit(NOT_AVAILABLE["concept_average_price"])),
        "top_products": top_products,
        "category_rating": category_rating,
        "revenue": revenue,
        "discount": lambda: profile("discount", "discount_percentage", "Discount Insights:\n\n", [
            ("Average Discount", "avg_discount", "%"), ("Maximum Discount", "max_discount", "%"),
            ("Minimum Discount", "min_discount", "%")]),
        "rating": lambda: profile("rating", "rating", "Rating Insights:\n\n", [
            ("Average Rating", "avg_rating", "/5"), ("Best Rating", "max_rating", "/5"),
            ("Lowest Rating", "min_rating", "/5")]),
        "count": lambda: F.concat(F.lit("Total Products: "), fmt_grouped(F.col("n_rows"), 0)),
        "price": price,
        "associations": lambda: _association_answer(df, tasks),
        "overview": lambda: narrate.overview_column(cols),  # same metrics row, no rescan
        "empty": lambda: F.lit(EMPTY_ANSWER),
    })
    packed = F.array(*[F.struct(F.lit(k).alias("intent"), _told(builders[k](), k).alias("answer"))
                       for k in wanted])
    return m.select(F.explode(packed).alias("a")).select("a.intent", "a.answer")


def _association_answer(df: DataFrame, tasks: int | None = None) -> Column:
    try:
        basket.basket_roles(df)
    except basket.BasketRolesMissing as missing:
        return F.lit(f"Product Associations:\n\n{missing.note}")
    rules = basket.top_rules(df, 10, tasks=tasks)
    line = F.concat(F.lit("• "), F.col("product_a"), F.lit(" + "), F.col("product_b"),
                    F.lit(" (Count: "), F.col("count").cast("string"), F.lit(", Support: "),
                    percent(F.col("support"), 2), F.lit(")\n"))
    body = _bullets(rules, basket.rule_order(), line, 10)
    return F.when(body.isNull() | (body == ""),
                  F.lit(f"Product Associations:\n\n{basket.NO_DATA}")) \
        .otherwise(F.concat(F.lit("Top Product Pairs (sold together):\n\n"), body))


def asked_intents(routed: DataFrame) -> list[str]:
    """The distinct intents among routed questions: at most one value per
    routing rule (about 20), the only thing that reaches the driver."""
    return [r.intent for r in routed.select("intent").distinct().collect()]


def answer_questions(df: DataFrame, questions: DataFrame, text_col: str = "question",
                     asked_only: bool = True) -> DataFrame:
    """Q2: question, intent, answer. The answer table has one row per intent
    (a fixed bound), so it is broadcast and the questions are never shuffled.
    With ``asked_only`` one small action first finds the intents asked, and
    only their answers are computed."""
    routed = question_intents(questions, text_col)
    intents = asked_intents(routed) if asked_only else None
    return routed.join(F.broadcast(answer_table(df, intents)), "intent", "left") \
        .select("question", "intent", "answer")


__all__ = ["intent_of", "question_intents", "answer_table", "answer_questions", "asked_intents"]
