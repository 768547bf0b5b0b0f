"""Queries over cleaning, aggregate and set operators."""

from __future__ import annotations

from ..operators import aggregate as agg
from ..sources import derived
from .registry import register


@register("store_activity", sql="""
  SELECT l_suppkey AS store, count(DISTINCT l_partkey) AS n_products,
         coalesce(sum(l_extendedprice), 0.0) AS total_amount
  FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey
""", round_cols=["total_amount"])
def store_activity(spark, sf_dir):
    """A1: distinct products and delivered amount per store."""
    return agg.store_activity(derived.deliveries(spark, sf_dir))


from pyspark.sql import functions as F  # noqa: E402

from ..functions import text as tx  # noqa: E402
from ..operators import clean  # noqa: E402
from ..sources.tables import load_table  # noqa: E402

_GAPS = derived.EVENTS_WITH_GAPS_SQL


@register("scan_profile", sql="""
  SELECT * FROM (
    SELECT 'o_orderkey' AS column, count(*) AS n_rows, count(*) - count(o_orderkey) AS n_missing, count(DISTINCT o_orderkey) AS n_distinct FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate), count(DISTINCT o_orderdate) FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders)
""")
def scan_profile(spark, sf_dir):
    """Scan profile of a table (rows, missing, distinct per column)."""
    from ..operators.profile import profile
    return profile(load_table(spark, sf_dir, "orders"))


@register("count_na", sql=f"""
  SELECT * FROM (
    SELECT 'event_id' AS column, count(*) - count(event_id) AS n_missing FROM ({_GAPS})
    UNION ALL SELECT 'ts', count(*) - count(ts) FROM ({_GAPS})
    UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM ({_GAPS})
    UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM ({_GAPS})
    UNION ALL SELECT 'value', count(*) - count(value) FROM ({_GAPS})
    UNION ALL SELECT 'props', count(*) - count(props) FROM ({_GAPS}))
""")
def count_na(spark, sf_dir):
    """Missing values per column, one aggregate pass."""
    return clean.count_na(derived.events_with_gaps(spark, sf_dir))


@register("clean_strings", sql=f"""
  SELECT doc_id,
         CASE WHEN regexp_replace(text, '{tx.VALUE_DROP_PATTERN.replace("'", "''")}', '', 'g') = 'nan' THEN NULL
              ELSE regexp_replace(text, '{tx.VALUE_DROP_PATTERN.replace("'", "''")}', '', 'g') END AS text,
         lang, source, n_chars
  FROM documents
""")
def clean_strings(spark, sf_dir):
    """Clean names and string values of whole documents."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return clean.clean_strings(docs, columns=["text"])


def _num_sql(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, '{tx.NUMERIC_PATTERN[1:-1]}') "
            f"OR regexp_full_match({x}, '\\s*[+-]?(?i)(inf|infinity)\\s*') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END")


@register("convert_types", sql=f"""
  SELECT event_id, {_num_sql("CAST(value AS VARCHAR)")} AS value_text,
         {_num_sql("json_extract_string(props, '$.k')")} AS k_text,
         {_num_sql("event_type")} AS event_type
  FROM events
""", round_cols=["value_text", "k_text", "event_type"])
def convert_types(spark, sf_dir):
    """Coerce text columns to numbers; text stays missing."""
    ev = load_table(spark, sf_dir, "events").select(
        "event_id", F.col("value").cast("string").alias("value_text"),
        F.get_json_object("props", "$.k").alias("k_text"), "event_type")
    return clean.convert_types(ev, ["value_text", "k_text", "event_type"])


@register("drop_na", sql=f"SELECT event_id, user_id, event_type, value FROM ({_GAPS}) WHERE value IS NOT NULL", round_cols=["value"])
def drop_na(spark, sf_dir):
    """P5: drop rows with a missing value in the listed column."""
    ev = derived.events_with_gaps(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    return clean.drop_na(ev, "value")


@register("fill_na_mean", sql=f"""
  SELECT event_id, coalesce(value, (SELECT avg(value) FROM ({_GAPS}))) AS value FROM ({_GAPS})
""", round_cols=["value"])
def fill_na_mean(spark, sf_dir):
    """Fill numeric missing values with the column mean."""
    ev = derived.events_with_gaps(spark, sf_dir).select("event_id", "value")
    return clean.fill_na(ev, ["value"], method="mean")


@register("fill_na_median", sql=f"""
  SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ({_GAPS}))) AS value FROM ({_GAPS})
""", round_cols=["value"])
def fill_na_median(spark, sf_dir):
    """Fill numeric missing values with the exact column median."""
    ev = derived.events_with_gaps(spark, sf_dir).select("event_id", "value")
    return clean.fill_na(ev, ["value"], method="median")


@register("fill_na_value", sql=f"""
  SELECT event_id, coalesce(value, 0.0) AS value, coalesce(props, '0') AS props FROM ({_GAPS})
""", round_cols=["value"])
def fill_na_value(spark, sf_dir):
    """Fill missing numbers and strings with 0."""
    ev = derived.events_with_gaps(spark, sf_dir).select("event_id", "value", "props")
    return clean.fill_na(ev, ["value", "props"], method="value", value=0)


@register("fill_na_ffill", sql=f"""
  SELECT event_id,
         last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
         last_value(props IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS props
  FROM ({_GAPS})
""", round_cols=["value"])
def fill_na_ffill(spark, sf_dir):
    """Forward fill in global event order (range-partitioned)."""
    ev = derived.events_with_gaps(spark, sf_dir).select("event_id", "value", "props")
    return clean.fill_na(ev, ["value", "props"], method="ffill", order_by=["event_id"])


@register("fill_na_bfill", sql=f"""
  SELECT event_id,
         first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value,
         first_value(props IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS props
  FROM ({_GAPS})
""", round_cols=["value"])
def fill_na_bfill(spark, sf_dir):
    """Backward fill in global event order."""
    ev = derived.events_with_gaps(spark, sf_dir).select("event_id", "value", "props")
    return clean.fill_na(ev, ["value", "props"], method="bfill", order_by=["event_id"])


@register("dedup_keep_first", sql="""
  SELECT store, business_day, l_orderkey, l_linenumber, l_extendedprice FROM (
    SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS business_day, l_orderkey, l_linenumber, l_extendedprice,
           row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) AS rn
    FROM lineitem) WHERE rn = 1
""", round_cols=["l_extendedprice"])
def dedup_keep_first(spark, sf_dir):
    """First row (by order key, line) per (store, day)."""
    li = load_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("store"), F.to_date("l_shipdate").alias("business_day"),
        "l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.dedup_keep_first(li, ["store", "business_day"], ["l_orderkey", "l_linenumber"])


@register("union_by_name", sql="""
  SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS kind FROM customer
  UNION ALL BY NAME
  SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, 'supplier' AS kind FROM supplier
""", round_cols=["acctbal"])
def union_by_name(spark, sf_dir):
    """Union by column name; absent columns are missing."""
    cust = load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("kind"))
    sup = load_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    return clean.union_by_name([cust, sup])


@register("parse_business_day", sql=f"""
  SELECT l_orderkey, l_linenumber, raw_day,
         CASE WHEN regexp_full_match(d, '\\d{{8}}') THEN CAST(try_strptime(d, '%Y%m%d') AS DATE) END AS business_day
  FROM (SELECT *, regexp_replace(regexp_replace(trim(raw_day), '^(\\d{{8}})\\.0*$', '\\1'), '[^\\d]', '', 'g') AS d
        FROM ({derived.RAW_BUSINESS_DAYS_SQL}))
""")
def parse_business_day(spark, sf_dir):
    """Strip, drop '.0', keep digits, parse yyyyMMdd (bad → NULL)."""
    raw = derived.raw_business_days(spark, sf_dir)
    return raw.select("l_orderkey", "l_linenumber", "raw_day",
                      tx.parse_yyyymmdd(F.col("raw_day")).alias("business_day"))


@register("earliest_day", sql=f"""
  SELECT store, min(business_day) AS earliest_day FROM ({derived.STORE_DAYS_SQL}) GROUP BY store
""")
def earliest_day(spark, sf_dir):
    """A2: earliest business day per store."""
    return agg.earliest_day(derived.store_days(spark, sf_dir))


@register("item_frequency", sql=f"""
  SELECT item, count(DISTINCT tx_id) AS n_transactions FROM ({derived.BASKET_LINES_SQL})
  GROUP BY item HAVING count(DISTINCT tx_id) >= 5
""")
def item_frequency(spark, sf_dir):
    """A3: distinct transactions per item, threshold 5."""
    return agg.item_frequency(derived.basket_lines(spark, sf_dir), min_transactions=5)


# The product group used by the semi-join query.
PROMO_BRANDS = ["Brand#11", "Brand#22", "Brand#33"]


@register("dim_semi_join", sql=f"""
  SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ({", ".join(repr(b) for b in PROMO_BRANDS)}))
""")
def dim_semi_join(spark, sf_dir):
    """Membership (left-semi) join against a product-group dimension."""
    from ..operators.joins import semi_join
    part = load_table(spark, sf_dir, "part")
    dim = part.filter(F.col("p_brand").isin(PROMO_BRANDS)).select(
        F.col("p_brand").alias("product_group"), F.col("p_partkey"))
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return semi_join(li, dim, li.l_partkey == dim.p_partkey)
