"""Every insight of one table as named lazy DataFrames.

``insights(df)`` mirrors the one-call analysis: it normalises nothing by itself
(call ``ingest.normalize`` or ``sources.files.read_table`` first), persists the
base table once (memory and disk; lost blocks are recomputed from lineage, so
an executor loss costs time, not results), adds the synthetic sales volume when
every row allows it, fits the two forests if asked, and returns a dict of
DataFrames. Nothing else runs until the caller acts on a result, e.g.
``sources.files.write_insights``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from shelfscope.operators import basket, catalog, charts, finance, models, narrate, schema
from shelfscope.plans.fused import FusedFigures


def _shared_base(df: DataFrame, mode: str) -> DataFrame:
    """``persist``: cached, lost blocks recomputed from lineage. ``checkpoint``:
    written once to the cluster's shared ``spark.checkpoint.dir`` (lineage cut);
    raises when the session names no such folder. ``none``."""
    if mode == "checkpoint":
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir is not set")
        df.sparkSession.sparkContext.setCheckpointDir(folder)
        return df.checkpoint(eager=True)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def insights(df: DataFrame, key_cols: list[str] | None = None, persist: bool = True,
             fit_models: bool = True, num_trees: int = 100, max_depth: int = 10,
             synthetic_sales: bool = True, base: str | None = None) -> dict[str, DataFrame]:
    """All insights of ``df``. ``synthetic_sales=False`` keeps an input
    ``sales_volume`` as it is instead of replacing it with the synthetic one.
    ``base`` picks how the shared input is kept: ``persist`` (default when
    ``persist`` is true), ``checkpoint`` or ``none``."""
    keep = (base or ("persist" if persist else "none")) != "none"
    base = _shared_base(df, base or ("persist" if persist else "none"))
    grouped = FusedFigures(base, keep).insights()
    if "price_bands" not in grouped:  # as in the original flow, the rating list comes with the revenue list
        grouped.pop("top_categories_by_rating", None)
    out: dict[str, DataFrame] = {"kpis": grouped["kpis"]}
    for name, made in (("top_categories_by_revenue",) * 2, ("top_categories_by_rating",) * 2,
                       ("price_band_distribution", "price_bands"), ("avg_price_by_category",) * 2,
                       ("avg_discount_by_category",) * 2, ("high_discount_avg_rating", "high_discount_rating"),
                       ("segmentation",) * 2):
        if made in grouped:
            out[name] = grouped[made]
    if fit_models:
        rating = models.rating_model(base, num_trees, max_depth, key_cols)
        if rating is not None:
            out["rating_model"] = rating.metrics
    # the synthetic volume is added before the product views, as in the original flow
    enriched = models.with_synthetic_sales(base, key_cols) if synthetic_sales else base
    # where the synthetic step cannot be done for every row, there is no sales model either,
    # even if the input brought a volume of its own
    sales_step = enriched is not base or not synthetic_sales
    if fit_models and sales_step and "sales_volume" in enriched.columns:
        sales = models.sales_model(enriched, num_trees, max_depth, key_cols)
        if sales is not None:
            out["sales_model"] = sales.metrics
    if schema.resolve(enriched, schema.PRODUCT):
        out["product_list"] = catalog.product_list(enriched)
        if schema.resolve(enriched, schema.SALES):
            out["top_selling_products"] = catalog.top_selling_products(enriched, 10)
            out["product_sales"] = catalog.product_sales(enriched)
    basis = catalog.sales_basis(enriched)
    out["sales_basis"] = df.sparkSession.createDataFrame([(basis,)], "sales_basis string")
    out["recommendations"] = narrate.recommendations(enriched, basis=basis)
    out["insights_explanation"] = narrate.insights_explanation(enriched)
    out["profit_loss"] = finance.profit_loss(enriched)
    out["avg_annual_expenditure"] = finance.avg_annual_expenditure(enriched)
    out["association_meta"] = basket.association_meta(enriched)
    try:
        basket.basket_roles(enriched)
        rules = basket.rules_table(enriched)
        if keep:
            rules = rules.persist(StorageLevel.MEMORY_AND_DISK)
        out["association_rules"] = rules.orderBy(*basket.rule_order())
        out["association_by_product"] = basket.partners_by_product(enriched, rules)
    except basket.BasketRolesMissing:
        pass
    if "product_list" in out:
        out["chart_top_products"] = charts.top_products(enriched)
    return out
