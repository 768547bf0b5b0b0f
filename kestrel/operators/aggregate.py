"""Grouped aggregates of the reference's jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_activity(deliveries: DataFrame, store: str = "store", product: str = "product",
                   amount: str = "amount") -> DataFrame:
    """Per store: number of distinct products and total delivered amount.

    NULL store keys are dropped (pandas ``groupby`` semantics), NULL products
    are not counted and an all-missing amount sums to 0.0. ``countDistinct``
    is planned by Spark as a two-level aggregate (expand on product), so a
    hot store is pre-aggregated map-side before the final shuffle.
    """
    return (
        deliveries.filter(F.col(store).isNotNull())
        .groupBy(store)
        .agg(
            F.countDistinct(product).alias("n_products"),
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"),
        )
    )


def earliest_day(facts: DataFrame, store: str = "store", day: str = "business_day") -> DataFrame:
    """Earliest business day per store (the store's own opening proxy)."""
    return (facts.filter(F.col(store).isNotNull())
            .groupBy(store).agg(F.min(day).alias("earliest_day")))


def item_frequency(lines: DataFrame, tx: str = "tx_id", item: str = "item",
                   min_transactions: int = 1) -> DataFrame:
    """Number of distinct transactions per item, kept when >= threshold."""
    clean = lines.filter(F.col(tx).isNotNull() & F.col(item).isNotNull())
    return (clean.groupBy(item).agg(F.countDistinct(tx).alias("n_transactions"))
            .filter(F.col("n_transactions") >= F.lit(min_transactions)))
