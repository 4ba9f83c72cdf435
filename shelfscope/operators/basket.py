"""Baskets, item and pair counts, association rules and partner lists.

Plan shape (all DataFrame operators, no arrays of pairs, no Python):

1. ``baskets``: distinct (transaction, item). Partial aggregation removes
   repeated lines inside each task before the shuffle.
2. ``item_pairs``: self equi-join of the baskets on the transaction with
   ``a < b``, followed at once by a partial ``count`` per (a, b), so each task
   ships at most one row per pair it saw.
   A basket may be very large (one order holding a third of all lines). Its
   pair work would land in one task, so every basket of more than ``chunk`` items
   (counted exactly) is split: each side gets a hash bucket of the item and is
   replicated over the other side's buckets, and the join key becomes (transaction,
   bucket_a, bucket_b). Every pair still meets exactly once; its work is spread
   over buckets^2 tasks, with no upper bound on the number of buckets. The table
   of factors is joined without a hint, so its size does not matter.
3. ``top_rules``: the n largest rules without counting all pairs. A pair is in no more
   baskets than either of its items, so the n-th best count among the most frequent
   items is a threshold that both items of any better pair must reach; only those are paired.
4. ``partner_counts``: pairs of some products only, formed from their baskets.
5. ``tasks`` (for large tables) deals baskets, and parts of baskets, into that many tasks, so that
   what a task sorts does not grow with the table; without it the session's settings decide.
   Where the session has fewer partitions, pairs are summed, and rules joined and sorted, in as many
   tasks: the more products there are, the more pairs. For that a task forms the pairs of its own
   baskets from their items (``_dealt_pairs``: the join on the transaction, without a dealing by it)
   and counts them before they are dealt by pair.
6. ``association_rules``: pair counts joined with item counts (AQE picks
   broadcast only if the measured item table is small), total transactions as
   a scalar subquery, ratios rounded half-up in integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numeric import half_up_ratio
from shelfscope.functions.text import clean_item, fmt_plain
from shelfscope.operators import schema

# Notes.
NO_PRODUCT = "Product name column not found."
NO_TRANSACTION = ("Transaction ID column not found. Add an order/transaction/basket ID "
                  "column to compute product pairs.")
NO_DATA = "No transaction data available to compute product pairs."
# (A fourth note, "No valid transactions found.", cannot occur: once rows missing a
# transaction or product are dropped, every remaining row belongs to a transaction.)


class BasketRolesMissing(ValueError):
    def __init__(self, note: str):
        super().__init__(note)
        self.note = note


def basket_roles(df: DataFrame) -> tuple[str, str]:
    product = schema.resolve(df, schema.PRODUCT)
    if product is None:
        raise BasketRolesMissing(NO_PRODUCT)
    txn = schema.resolve(df, schema.TRANSACTION)
    if txn is None:
        raise BasketRolesMissing(NO_TRANSACTION)
    return txn, product


def baskets(df: DataFrame) -> DataFrame:
    """B1: distinct (txn, item); rows missing either are dropped, items trimmed."""
    txn, product = basket_roles(df)
    return (df.where(F.col(txn).isNotNull() & F.col(product).isNotNull())
            .select(F.col(txn).alias("txn"), clean_item(F.col(product)).alias("item"))
            .distinct())


def basket_sizes(df: DataFrame) -> DataFrame:
    """Distinct items per basket."""
    return baskets(df).groupBy("txn").agg(F.count(F.lit(1)).alias("n_items"))


def item_counts(df: DataFrame) -> DataFrame:
    """B2: number of baskets holding each item (one-item baskets included)."""
    return baskets(df).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def split_factors(b: DataFrame, chunk: int) -> DataFrame:
    """(txn, s) of every basket with more than ``chunk`` items: s = ceil(items / chunk)."""
    sizes = b.groupBy("txn").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > chunk).select("txn", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("s"))


def item_pairs(df: DataFrame, chunk: int = 2000, min_count: int = 1, tasks: int | None = None) -> DataFrame:
    """Baskets holding both a and b, for every a < b (code-point order).

    Baskets under two items produce nothing. A basket of more than ``chunk`` items
    is split, so that a task pairs at most about chunk x chunk of its items; the
    result does not depend on it. ``min_count`` (off by default) leaves out rarer pairs.
    """
    pairs = pair_counts(baskets(df), chunk, tasks)
    return pairs.where(F.col("count") >= min_count) if min_count > 1 else pairs


def _more_tasks(df: DataFrame, tasks: int | None) -> int | None:
    """``tasks`` if the session's own partitions are fewer."""
    return tasks if tasks and tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _salted(b: DataFrame, chunk: int, tasks: int | None) -> DataFrame:
    """The baskets with each item's bucket (own), once for every bucket that it meets (other)."""
    if tasks:
        b = b.repartition(tasks, "txn")
    return (b.join(split_factors(b, chunk), "txn", "left")
            .withColumn("s", F.coalesce(F.col("s"), F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("item"), F.col("s")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))))


def _sides(b: DataFrame, chunk: int, a: str, other: str, tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self join of baskets on (txn, ba, bb); large baskets are split."""
    salted = _salted(b, chunk, tasks)
    sides = (salted.select("txn", F.col("item").alias(a), F.col("own").alias("ba"), F.col("other").alias("bb")),
             salted.select("txn", F.col("item").alias(other), F.col("other").alias("ba"), F.col("own").alias("bb")))
    return tuple(side.repartition(tasks, "txn", "ba", "bb") for side in sides) if tasks else sides


def _dealt_pairs(b: DataFrame, chunk: int, tasks: int) -> DataFrame:
    """(slot, product_a, product_b) for each basket and each of its pairs, a < b; a slot is a task.

    A join would be dealt by all of its keys, and then no count by slot could precede the dealing by
    pair. A part of a basket holds its items of two buckets, about ``chunk`` of each at most.
    """
    parts = _salted(b, chunk, tasks).select("txn", "item", "own", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"))
    slots = (parts.withColumn("slot", F.pmod(F.xxhash64("txn", "ba", "bb"), F.lit(tasks)).cast("int"))
             .repartitionById(tasks, "slot").groupBy("slot", "txn", "ba", "bb")
             .agg(F.collect_list(F.when(F.col("own") == F.col("ba"), F.col("item"))).alias("xs"),
                  F.collect_list(F.when(F.col("own") == F.col("bb"), F.col("item"))).alias("ys")))
    return (slots.select("slot", "ba", "bb", "ys", F.explode("xs").alias("x")).select("slot", "ba", "bb", "x", F.explode("ys").alias("y"))
            .where((F.col("ba") < F.col("bb")) | (F.col("x") < F.col("y")))  # two buckets share no item
            .select("slot", F.least("x", "y").alias("product_a"), F.greatest("x", "y").alias("product_b")))


def pair_counts(b: DataFrame, chunk: int = 2000, tasks: int | None = None) -> DataFrame:
    """(product_a, product_b, count) of the baskets ``b``, a < b."""
    if more := _more_tasks(b, tasks):
        by_slot = _dealt_pairs(b, chunk, more).groupBy("slot", "product_a", "product_b").agg(F.count(F.lit(1)).alias("n"))
        return (by_slot.repartition(more, "product_a", "product_b")
                .groupBy("product_a", "product_b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")))
    left, right = _sides(b, chunk, "product_a", "product_b", tasks)
    return (left.join(right, ["txn", "ba", "bb"])
            .where(F.col("product_a") < F.col("product_b"))
            .groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("count")))


def partner_counts(b: DataFrame, products: DataFrame, chunk: int = 2000, tasks: int | None = None) -> DataFrame:
    """(product, partner, count) for the items in ``products`` (column product) only."""
    left, right = _sides(b, chunk, "product", "partner", tasks)
    return (left.join(products, "product", "left_semi").join(right, ["txn", "ba", "bb"])
            .where(F.col("product") != F.col("partner"))
            .groupBy("product", "partner").agg(F.count(F.lit(1)).alias("count")))


def _item_counts(b: DataFrame) -> DataFrame:
    return b.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def frequent_enough(b: DataFrame, n: int, chunk: int = 2000, tasks: int | None = None) -> DataFrame:
    """(item) of all items that one of the n most frequent pairs may hold.

    The most frequent items are paired first. The n-th best of their counts is reached by n pairs at
    least, so an item in fewer baskets is in none of the n best; equal counts stay.
    """
    counts = _item_counts(b)
    seeds = counts.orderBy(F.col("n").desc(), "item").limit(max(2 * n, 32)).select("item")
    best = pair_counts(b.join(F.broadcast(seeds), "item", "left_semi"), chunk, tasks).orderBy(F.col("count").desc()).limit(n)
    threshold = best.agg(F.when(F.count(F.lit(1)) == n, F.min("count")).otherwise(0)).scalar()
    return counts.where(F.col("n") >= threshold).select("item")


def top_rules(df: DataFrame, n: int, chunk: int = 2000, tasks: int | None = None) -> DataFrame:
    """The first n rows of ``association_rules``, in their order."""
    b = baskets(df)
    pairs = pair_counts(b.join(frequent_enough(b, n, chunk, tasks), "item", "left_semi"), chunk, tasks)
    return _rules(b, pairs.orderBy(F.col("count").desc(), "product_a", "product_b").limit(n)).orderBy(*rule_order())


def total_transactions(b: DataFrame) -> DataFrame:
    return b.agg(F.countDistinct("txn").alias("total_transactions"))


def rules_table(df: DataFrame, **split) -> DataFrame:
    """B4 (+J3): support and both confidences, rounded to 4 places; no minimum
    support and no lift. Unordered: consumers that rank or take the top rows
    order it themselves, so no global sort is paid for nothing."""
    return _rules(baskets(df), item_pairs(df, **split), split.get("tasks"))


def _rules(b: DataFrame, pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    counts = _item_counts(b)
    total = total_transactions(b).scalar()
    ca = counts.select(F.col("item").alias("product_a"), F.col("n").alias("n_a"))
    cb = counts.select(F.col("item").alias("product_b"), F.col("n").alias("n_b"))
    if more := _more_tasks(b, tasks):  # pairs follow unless the counts are broadcast
        ca, cb = ca.repartition(more, "product_a"), cb.repartition(more, "product_b")
    return (pairs.join(ca, "product_a").join(cb, "product_b")
            .select("product_a", "product_b", "count",
                    half_up_ratio(F.col("count"), total).alias("support"),
                    half_up_ratio(F.col("count"), F.col("n_a")).alias("confidence_a_to_b"),
                    half_up_ratio(F.col("count"), F.col("n_b")).alias("confidence_b_to_a")))


def rule_order() -> list:
    """T4: count desc, support desc, product_a, then product_b for a total order."""
    return [F.col("count").desc(), F.col("support").desc(), F.col("product_a"), F.col("product_b")]


def association_rules(df: DataFrame, **split) -> DataFrame:
    """B4 + T4: the rules in their reporting order."""
    rules = rules_table(df, **split)
    if more := _more_tasks(df, split.get("tasks")):
        return rules.repartitionByRange(more, *rule_order()).sortWithinPartitions(*rule_order())
    return rules.orderBy(*rule_order())


def partners_by_product(df: DataFrame, rules: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """B5 (+T5): every rule listed under both of its items, ranked per product by
    count desc, support desc, partner. Ranking is per product, so a window
    partition holds at most one row per other product."""
    rules = rules if rules is not None else rules_table(df, tasks=tasks)
    both = rules.select(F.explode(F.array(
        F.struct(F.col("product_a").alias("product"), F.col("product_b").alias("partner"),
                 "count", "support"),
        F.struct(F.col("product_b").alias("product"), F.col("product_a").alias("partner"),
                 "count", "support"))).alias("e")).select("e.*")
    w = Window.partitionBy("product").orderBy(F.col("count").desc(), F.col("support").desc(),
                                              F.col("partner"))
    return both.withColumn("rank", F.row_number().over(w))


def association_meta(df: DataFrame) -> DataFrame:
    """Total transactions, distinct items, note ('' when rules exist)."""
    spark = df.sparkSession
    try:
        b = baskets(df)
    except BasketRolesMissing as missing:
        return spark.createDataFrame([(0, 0, missing.note)],
                                     "total_transactions long, unique_products long, note string")
    return b.agg(F.countDistinct("txn").alias("total_transactions"),
                 F.countDistinct("item").alias("unique_products")) \
        .withColumn("note", F.when(F.col("total_transactions") == 0, F.lit(NO_DATA))
                    .otherwise(F.lit("")))


def bought_together_cards(df: DataFrame, n_rules: int = 8, n_products: int = 12,
                          n_partners: int = 3, tasks: int | None = None) -> DataFrame:
    """B8 (+T6): plain-text cards. ``rule`` cards for the first n_rules rules;
    ``product`` cards for the first n_products products by name, each with its
    top n_partners partners and the number of partners. No other pairs are counted than
    those that these cards may hold."""
    b = baskets(df)
    total = total_transactions(b).scalar()
    best = top_rules(df, n_rules, tasks=tasks)
    conf = fmt_plain(F.col("confidence_a_to_b") * 100, 1)
    supp = fmt_plain(F.col("support") * 100, 1)
    rule_cards = best.select(
        F.lit("rule").alias("kind"),
        # numbered after the limit: the window sees at most n_rules rows
        F.row_number().over(Window.orderBy(*rule_order())).alias("position"),
        F.concat_ws(" ↔ ", "product_a", "product_b").alias("title"),
        F.concat(F.lit("When customers purchase "), F.col("product_a"),
                 F.lit(", they also purchase "), F.col("product_b"), F.lit(" in "),
                 F.col("count").cast("string"), F.lit(" out of "), total.cast("string"),
                 F.lit(" transactions. This happens "), conf, F.lit("% of the time.")).alias("body"),
        F.concat(F.lit("Support: "), supp, F.lit("% | Confidence: "), conf, F.lit("%"))
         .alias("stats"))
    # a product has partners if one of its baskets holds something else
    paired = b.join(b.groupBy("txn").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("txn"), "txn", "left_semi")
    listed_products = paired.select(F.col("item").alias("product")).distinct().orderBy("product").limit(n_products)
    counted = partner_counts(b, listed_products, tasks=tasks)
    # at most n_products groups, each with one row for every other product
    ranked = counted.withColumn("rank", F.row_number().over(
        Window.partitionBy("product").orderBy(F.col("count").desc(), "partner")))
    firsts = ranked.groupBy("product").agg(
        F.count(F.lit(1)).alias("n_partners"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= n_partners,
                                           F.struct("rank", "partner", "count")))).alias("top"))
    listed = F.array_join(F.transform(
        "top", lambda e: F.concat(e["partner"], F.lit(" ("), e["count"].cast("string"), F.lit("x)"))),
        ", ")
    product_cards = firsts.select(
        F.lit("product").alias("kind"),
        F.row_number().over(Window.orderBy("product")).alias("position"),
        F.col("product").alias("title"),
        F.concat(F.lit("Often bought with: "), listed, F.lit(". When customers buy "),
                 F.col("product"), F.lit(", they frequently also purchase "),
                 F.col("top")[0]["partner"], F.lit(". This occurs in "),
                 F.col("top")[0]["count"].cast("string"), F.lit(" transactions.")).alias("body"),
        F.concat(F.col("n_partners").cast("string"), F.lit(" complementary products identified"))
         .alias("stats"))
    return rule_cards.unionByName(product_cards)
