"""Market-basket mining (B1-B5): transactions, frequent item sets by
MLlib's parallel FP-Growth, and association rules with consequents of any
size, grown level by level as DataFrame joins.

Support denominators are the transactions that survive the item-frequency
filter (a transaction made only of rare items disappears)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import bounded_broadcast

_SEP = "\u0001"
RULE_COLUMNS = ["antecedents", "consequents", "support", "confidence", "lift"]


def basket_transactions(lines: DataFrame, tx: str = "tx_id", item: str = "item",
                        min_item_frequency: int = 2) -> DataFrame:
    """B1: ``(tx_id, items)`` with items sorted and distinct, after dropping
    missing values and items seen in fewer than ``min_item_frequency``
    distinct transactions (semi join)."""
    clean = lines.select(F.col(tx).alias("tx_id"), F.col(item).alias("item")).dropna()
    freq = (clean.groupBy("item").agg(F.countDistinct("tx_id").alias("_n"))
            .filter(F.col("_n") >= F.lit(min_item_frequency)).select(F.col("item").alias("_item")))
    kept = clean.join(bounded_broadcast(freq), clean.item == freq._item, "left_semi")
    return kept.groupBy("tx_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def frequent_itemsets(transactions: DataFrame, min_support: float = 0.01, max_length: int | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """B2: ``(items, freq, support, size)`` via ``pyspark.ml.fpm.FPGrowth``;
    ``max_length`` filters the result (FP-Growth has no length bound)."""
    spark = transactions.sparkSession
    # the transactions feed a count and several FP-Growth passes: persist
    # once (memory and disk); the frequent sets (bounded by the support
    # threshold, not by rows) are persisted too, because the model's table
    # is RDD-backed and would re-mine on every action
    transactions = transactions.select("items").persist(StorageLevel.MEMORY_AND_DISK)
    n_tx = transactions.count()
    if n_tx == 0:
        return spark.createDataFrame([], "items array<string>, freq long, support double, size int")
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(transactions)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long"))
    sets = sets.withColumn("size", F.size("items")).withColumn("support", F.col("freq") / F.lit(float(n_tx)))
    if max_length is not None:
        sets = sets.filter(F.col("size") <= F.lit(max_length))
    sets = sets.select("items", "freq", "support", "size").persist(StorageLevel.MEMORY_AND_DISK)
    sets.count()
    transactions.unpersist()
    return sets


def association_rules(itemsets: DataFrame, min_confidence: float = 0.01, min_lift: float = 0.01
                      ) -> DataFrame:
    """Every rule A → C of a frequent set whose confidence is reached,
    C of any size.

    Consequents grow level by level: if A → C misses the confidence, so does
    every rule of the same set with a larger C, because its antecedent is
    smaller and not rarer. A level's consequents are pairs of the level before
    that differ in their last item, so a set of m items costs what its rules
    cost and not 2^m splits. The supports of antecedents and consequents are
    equi-joins on the item-set key. The lift filter is applied at the end: it
    is not monotone."""
    ensure_checkpoint_dir(itemsets.sparkSession)
    key = lambda c: F.array_join(c, _SEP)
    sup = itemsets.select(key("items").alias("a_key"), F.col("support").alias("a_sup"))
    big = itemsets.where(F.col("size") >= 2).select("items", "support", "size")

    def confident(splits: DataFrame) -> DataFrame:
        ante = F.array_except("items", "cons")
        joined = splits.withColumn("ante", ante).withColumn("a_key", key("ante")).join(sup, "a_key")
        return joined.where(F.col("support") / F.col("a_sup") >= F.lit(min_confidence)).select("items", "support", "size", "ante", "cons", "a_sup")

    level = confident(big.withColumn("cons", F.explode(F.transform("items", lambda x: F.array(x))))).checkpoint()
    levels, n = [level], 1
    while True:
        n += 1
        parts = level.where(F.col("size") > n).select("items", "support", "size", F.slice("cons", 1, n - 2).alias("head"), F.element_at("cons", -1).alias("tail"))
        other = parts.select(key("items").alias("set_key"), F.col("head").alias("o_head"), F.col("tail").alias("o_tail"))
        same = (key("items") == F.col("set_key")) & (F.col("head") == F.col("o_head")) & (F.col("tail") < F.col("o_tail"))
        grown = parts.join(other, same).select("items", "support", "size", F.concat("head", F.array("tail", "o_tail")).alias("cons"))
        level = confident(grown).checkpoint()
        if level.isEmpty():
            break
        levels.append(level)
    rules = levels[0]
    for more in levels[1:]:
        rules = rules.unionByName(more)
    rules = rules.withColumn("c_key", key("cons")).join(sup.select(F.col("a_key").alias("c_key"), F.col("a_sup").alias("c_sup")), "c_key")
    conf = F.col("support") / F.col("a_sup")
    lift = conf / F.col("c_sup")
    out = rules.select(F.array_join("ante", ", ").alias("antecedents"), F.array_join("cons", ", ").alias("consequents"),
                       "support", conf.alias("confidence"), lift.alias("lift"),
                       F.col("a_sup").alias("antecedent_support"), F.col("c_sup").alias("consequent_support"))
    return out.where(F.col("lift") >= F.lit(min_lift))


def top_rules(rules: DataFrame, n: int = 20, label_top: int = 5) -> DataFrame:
    """Rules by lift descending (deterministic ties), first ``n``,
    with a label for the first ``label_top`` (scatter-plot data)."""
    w = Window.orderBy(F.col("lift").desc(), "antecedents", "consequents")
    top = rules.orderBy(F.col("lift").desc(), "antecedents", "consequents").limit(n)
    top = top.withColumn("rank", F.row_number().over(w))
    return top.withColumn("label", F.when(F.col("rank") <= label_top,
                                          F.concat_ws(" → ", "antecedents", "consequents")))


@dataclass
class BasketResult:
    transactions: DataFrame
    itemsets: DataFrame
    rules: DataFrame
    summary: DataFrame


def market_basket_analysis(lines: DataFrame, tx: str = "tx_id", item: str = "item",
                           min_support: float = 0.01, min_confidence: float = 0.01, min_lift: float = 0.01,
                           max_length: int | None = None, min_item_frequency: int = 2) -> BasketResult:
    """The reference's basket job end to end (code defaults, not docstring
    defaults). An empty input yields empty tables with fixed columns."""
    for c in (tx, item):
        if c not in lines.columns:
            raise ValueError(f"column {c!r} not in data")
    txs = basket_transactions(lines, tx, item, min_item_frequency).cache()
    sets = frequent_itemsets(txs, min_support, max_length).cache()
    rules = association_rules(sets, min_confidence, min_lift)
    summary = basket_summary(txs, sets, rules, min_support, min_confidence, min_lift, max_length,
                             min_item_frequency)
    return BasketResult(txs, sets, rules, summary)


def basket_summary(txs: DataFrame, sets: DataFrame, rules: DataFrame, min_support, min_confidence, min_lift,
                   max_length, min_item_frequency) -> DataFrame:
    """Thresholds and counts in one row."""
    counts = (
        txs.count(),
        txs.select(F.explode("items").alias("i")).agg(F.countDistinct("i")).first()[0],
        sets.count(),
        rules.count(),
    )
    spark = txs.sparkSession
    row = (float(min_support), float(min_confidence), float(min_lift),
           None if max_length is None else int(max_length), int(min_item_frequency), *[int(c) for c in counts])
    return spark.createDataFrame([row], "min_support double, min_confidence double, min_lift double, "
                                        "max_length int, min_item_frequency int, n_transactions long, "
                                        "n_items long, n_itemsets long, n_rules long")
