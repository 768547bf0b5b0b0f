"""Market-basket queries: orders as transactions, part brands as items.

Oracle SQL lists all subsets of every transaction by recursion and counts
them; item sets and rules of any size are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import basket as bk
from ..sources import derived
from .registry import register

# Fixed parameters of the checked basket job (code defaults of the
# reference except the item-frequency filter of its job script and a
# support low enough to produce larger sets).
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.01
MIN_LIFT = 0.01
MIN_ITEM_FREQUENCY = 5


def _txs(spark, sf_dir):
    return bk.basket_transactions(derived.basket_lines(spark, sf_dir), min_item_frequency=MIN_ITEM_FREQUENCY)


def _sets(spark, sf_dir, max_length=None):
    return bk.frequent_itemsets(_txs(spark, sf_dir), MIN_SUPPORT, max_length)


_L = f"""(SELECT DISTINCT tx_id, item FROM ({derived.BASKET_LINES_SQL}) WHERE tx_id IS NOT NULL AND item IS NOT NULL
         AND item IN (SELECT item FROM ({derived.BASKET_LINES_SQL}) GROUP BY item
                      HAVING count(DISTINCT tx_id) >= {MIN_ITEM_FREQUENCY}))"""
# All subsets of each transaction's items, of any size, then their counts.
_WITH = f"""
WITH RECURSIVE l AS MATERIALIZED {_L},
n AS (SELECT count(DISTINCT tx_id) AS n FROM l),
subsets(tx_id, items) AS (SELECT tx_id, [item] FROM l UNION ALL
    SELECT s.tx_id, list_append(s.items, l.item) FROM subsets s JOIN l ON l.tx_id = s.tx_id AND l.item > s.items[-1]),
freq AS MATERIALIZED (SELECT items, array_to_string(items, ', ') AS k, CAST(len(items) AS INTEGER) AS size, count(*) AS freq, count(*) / any_value(n.n) AS support
                      FROM subsets, n GROUP BY items HAVING count(*) >= {MIN_SUPPORT} * any_value(n.n)),
splits AS (SELECT a.k AS ante, a.support AS a_sup, array_to_string(list_filter(f.items, lambda x: NOT list_contains(a.items, x)), ', ') AS cons, f.support
           FROM freq f JOIN freq a ON a.size < f.size AND list_has_all(f.items, a.items)),
rules AS MATERIALIZED (SELECT s.ante AS antecedents, s.cons AS consequents, s.support, s.support / s.a_sup AS confidence, s.support / s.a_sup / c.support AS lift
                       FROM splits s JOIN freq c ON c.k = s.cons
                       WHERE s.support / s.a_sup >= {MIN_CONFIDENCE} AND s.support / s.a_sup / c.support >= {MIN_LIFT})"""


@register("basket_transactions", sql=f"""
  SELECT tx_id, count(*) AS n_items, string_agg(item, ', ' ORDER BY item) AS items FROM {_L} GROUP BY tx_id
""")
def basket_transactions(spark, sf_dir):
    """B1: filtered transactions (items sorted, distinct)."""
    t = _txs(spark, sf_dir)
    return t.select("tx_id", F.size("items").cast("long").alias("n_items"),
                    F.array_join("items", ", ").alias("items"))


@register("frequent_itemsets", sql=f"{_WITH} SELECT k AS items, freq, support, size FROM freq",
          round_cols=["support"])
def frequent_itemsets(spark, sf_dir):
    """B2: FP-Growth frequent item sets of every size."""
    s = _sets(spark, sf_dir)
    return s.select(F.array_join("items", ", ").alias("items"), "freq", "support", "size")


@register("frequent_pairs", sql=f"{_WITH} SELECT items[1] AS item_a, items[2] AS item_b, freq, support FROM freq WHERE size = 2",
          round_cols=["support"])
def frequent_pairs(spark, sf_dir):
    """B2: frequent 2-item sets."""
    s = _sets(spark, sf_dir, 2).filter(F.col("size") == 2)
    return s.select(F.col("items")[0].alias("item_a"), F.col("items")[1].alias("item_b"), "freq", "support")


@register("association_rules", sql=f"{_WITH} SELECT * FROM rules", round_cols=["support", "confidence", "lift"])
def association_rules(spark, sf_dir):
    """Rules for every split (multi-item consequents)."""
    return bk.association_rules(_sets(spark, sf_dir), MIN_CONFIDENCE, MIN_LIFT).select(*bk.RULE_COLUMNS)


@register("top_rules", sql=f"""{_WITH}
  SELECT *, row_number() OVER (ORDER BY lift DESC, antecedents, consequents) AS rank,
         CASE WHEN row_number() OVER (ORDER BY lift DESC, antecedents, consequents) <= 5
              THEN antecedents || ' → ' || consequents END AS label
  FROM rules ORDER BY lift DESC, antecedents, consequents LIMIT 20
""", round_cols=["support", "confidence", "lift"])
def top_rules(spark, sf_dir):
    """Top 20 rules by lift, top 5 labelled."""
    rules = bk.association_rules(_sets(spark, sf_dir), MIN_CONFIDENCE, MIN_LIFT).select(*bk.RULE_COLUMNS)
    return bk.top_rules(rules, 20, 5)


@register("basket_summary", sql=f"""{_WITH}
  SELECT {float(MIN_SUPPORT)} AS min_support, {float(MIN_CONFIDENCE)} AS min_confidence, {float(MIN_LIFT)} AS min_lift,
         CAST(NULL AS INTEGER) AS max_length, CAST({MIN_ITEM_FREQUENCY} AS INTEGER) AS min_item_frequency,
         (SELECT n FROM n) AS n_transactions, (SELECT count(DISTINCT item) FROM l) AS n_items,
         (SELECT count(*) FROM freq) AS n_itemsets, (SELECT count(*) FROM rules) AS n_rules
""", round_cols=["min_support", "min_confidence", "min_lift"])
def basket_summary(spark, sf_dir):
    """Thresholds and counts."""
    res = bk.market_basket_analysis(derived.basket_lines(spark, sf_dir), min_support=MIN_SUPPORT,
                                    min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT,
                                    min_item_frequency=MIN_ITEM_FREQUENCY)
    return res.summary
