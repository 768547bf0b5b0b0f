"""Input tables of the reference's jobs, derived by Spark from the driver
tables so that their size grows with the data (see FIXTURES.md).

* ``store_days``      F1: one row per (store, business day) with revenue,
                      ticket and member metrics (lineitem ⋈ orders ⋈ customer)
* ``competitor_events`` F2: competitor openings per store (supplier)
* ``basket_lines``    F3: (tx_id, item) transaction lines (lineitem ⋈ part)
* ``deliveries``      F4: (store, product, amount) (lineitem)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load_table

# Fixed values of the derivation (FIXTURES.md): member segment, first
# competitor opening date.
MEMBER_SEGMENT = "BUILDING"
EVENT_BASE_DATE = "1998-01-01"


def store_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily store facts.

    Plan: orders ⋈ customer first (orders is 4x smaller than lineitem), then
    lineitem ⋈ flagged orders on the order key; both joins are equi-joins
    that Spark plans as shuffle (or AQE-broadcast) joins. Lines are summed
    by (order, store, day) where the join left them, then partial/final on
    (store, day).
    """
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    flagged = orders.join(cust, orders.o_custkey == cust.c_custkey, "left").select(
        "o_orderkey", (F.col("c_mktsegment") == F.lit(MEMBER_SEGMENT)).alias("is_member"))
    # revenue in exact 1e-4 units (cents x percent) summed as long, so that
    # store-day revenue does not depend on summation order
    rev = (F.round(F.col("l_extendedprice") * 100).cast("long")
           * F.round((F.lit(1.0) - F.col("l_discount")) * 100).cast("long"))
    member = F.coalesce(F.col("is_member"), F.lit(False))
    joined = li.join(flagged, li.l_orderkey == flagged.o_orderkey, "left")
    # an order's lines of a store-day first: their rows already lie together by
    # order key, so the distinct orders are plain counts and no row is copied
    ticket = joined.groupBy(
        "l_orderkey",
        F.col("l_suppkey").alias("store"),
        F.to_date("l_shipdate").alias("business_day"),
    ).agg(
        F.sum(rev).alias("rev"),
        F.sum(F.when(member, rev).otherwise(F.lit(0))).alias("member_rev"),
        F.max(member).alias("member"),
    )
    has_key = F.col("l_orderkey").isNotNull()
    agg = ticket.groupBy("store", "business_day").agg(
        (F.sum("rev") / F.lit(10000.0)).alias("revenue"),
        F.count_if(has_key).cast("double").alias("tickets"),
        (F.sum("member_rev") / F.lit(10000.0)).alias("member_sales"),
        F.count_if(has_key & F.col("member")).cast("double").alias("member_tickets"),
    )
    return agg.select(
        "store", "business_day", "revenue", "tickets",
        F.try_divide("revenue", "tickets").alias("rev_per_ticket"),
        "member_sales", "member_tickets",
        F.when(F.col("member_tickets") > 0, F.col("member_sales") / F.col("member_tickets"))
        .alias("member_rev_per_ticket"),
    )


STORE_DAYS_SQL = f"""
  SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS business_day,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) / 10000.0 AS revenue,
         CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS tickets,
         sum(CASE WHEN c.c_mktsegment = '{MEMBER_SEGMENT}' THEN CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT) ELSE 0 END) / 10000.0 AS member_sales,
         CAST(count(DISTINCT CASE WHEN c.c_mktsegment = '{MEMBER_SEGMENT}' THEN l_orderkey END) AS DOUBLE) AS member_tickets
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
       LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""


def competitor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per store x competitor; every store with ``s_suppkey % 10 = 1``
    gets a second competitor so the per-event (not per-store) join is
    exercised."""
    sup = load_table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    second = (k % 10) == 1
    slots = F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = sup.select(k, F.explode(slots).alias("slot"))
    offset = (k * 7 + F.col("slot") * 45) % 365
    return rows.select(
        (k * 10 + F.col("slot")).alias("event_id"),
        k.alias("store"),
        F.when(k % 3 != 0, F.lit("Y")).otherwise(F.lit("N")).alias("has_competitor"),
        F.concat(F.lit("rival_"), k.cast("string"), F.lit("_"), F.col("slot").cast("string"))
        .alias("competitor_name"),
        F.concat(F.lit("brand_"), (k % 4).cast("string")).alias("competitor_brand"),
        ((k % 9) * 0.5 + 0.5).alias("competitor_distance"),
        F.date_add(F.lit(EVENT_BASE_DATE).cast("date"), offset.cast("int")).alias("open_date"),
    )


COMPETITOR_EVENTS_SQL = f"""
  SELECT s_suppkey * 10 + slot AS event_id, s_suppkey AS store,
         CASE WHEN s_suppkey % 3 <> 0 THEN 'Y' ELSE 'N' END AS has_competitor,
         'rival_' || CAST(s_suppkey AS VARCHAR) || '_' || CAST(slot AS VARCHAR) AS competitor_name,
         'brand_' || CAST(s_suppkey % 4 AS VARCHAR) AS competitor_brand,
         (s_suppkey % 9) * 0.5 + 0.5 AS competitor_distance,
         CAST(DATE '{EVENT_BASE_DATE}' + CAST((s_suppkey * 7 + slot * 45) % 365 AS INTEGER) AS DATE) AS open_date
  FROM supplier, (SELECT unnest([0, 1]) AS slot) s
  WHERE slot = 0 OR s_suppkey % 10 = 1
"""


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id string, item string): order key as text, part brand as item."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("tx_id"), F.col("p_brand").alias("item"))


BASKET_LINES_SQL = """
  SELECT CAST(l_orderkey AS VARCHAR) AS tx_id, p_brand AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("product"),
                     F.col("l_extendedprice").alias("amount"))


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with missing values injected deterministically (FIXTURES
    F6): ``value`` missing where event_id % 7 = 0, ``props`` where % 11 = 0.
    Every row is kept."""
    ev = load_table(spark, sf_dir, "events")
    k = F.col("event_id")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("props")).alias("props"),
    )


EVENTS_WITH_GAPS_SQL = """
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS props
  FROM events
"""


def raw_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business-day text in the raw forms the cleaning must handle
    (``yyyymmdd``, ``yyyymmdd.0``, padded, dashed, impossible dates)."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    d = F.date_format("l_shipdate", "yyyyMMdd")
    form = F.col("l_linenumber") % 5
    raw = (F.when(form == 0, F.concat(d, F.lit(".0")))
           .when(form == 1, F.concat(F.lit("  "), d, F.lit(" ")))
           .when(form == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
           .when(form == 3, F.concat(F.substring(d, 1, 6), F.lit("31")))
           .otherwise(d))
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw_day"))


RAW_BUSINESS_DAYS_SQL = """
  SELECT l_orderkey, l_linenumber,
         CASE l_linenumber % 5
           WHEN 0 THEN strftime(l_shipdate, '%Y%m%d') || '.0'
           WHEN 1 THEN '  ' || strftime(l_shipdate, '%Y%m%d') || ' '
           WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d')
           WHEN 3 THEN substr(strftime(l_shipdate, '%Y%m%d'), 1, 6) || '31'
           ELSE strftime(l_shipdate, '%Y%m%d') END AS raw_day
  FROM lineitem
"""


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with whole-text counts as numeric features.

    The counts are taken before the join: no text is shuffled with the labels,
    and no filter on the counts, which Spark moves into the join, counts again."""
    lab = load_table(spark, sf_dir, "labels")
    t = F.col("text")
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (_n_ascii(t, "\n") + 1).cast("double").alias("n_lines"),
        _n_ascii(t, " ").cast("double").alias("n_spaces"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("double").alias("n_upper"))
    return lab.join(docs, "doc_id").select("doc_id", "quality", "toxic", *DOC_FEATURES)


def _n_ascii(t, char: str):
    """How often an ASCII character (one byte) stands in ``t``."""
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(char), F.lit("")))


DOCUMENT_FEATURES_SQL = """
  SELECT doc_id, quality, toxic, CAST(n_chars AS DOUBLE) AS n_chars,
         CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
         CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS n_upper
  FROM labels JOIN documents USING (doc_id)
"""
DOC_FEATURES = ["n_chars", "n_lines", "n_spaces", "n_upper"]


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balance and order aggregates (customers with orders)."""
    cust = load_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = load_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    return cust.join(o, cust.c_custkey == o.o_custkey).select(
        "c_custkey", "c_mktsegment", "c_acctbal", "n_orders", "avg_price")


CUSTOMER_FEATURES_SQL = """
  SELECT c_custkey, c_mktsegment, c_acctbal, n_orders, avg_price FROM customer
  JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey)
    ON c_custkey = o_custkey
"""
CUSTOMER_FEATURES = ["c_acctbal", "n_orders", "avg_price"]


def embedding_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings with the vector spread over numeric columns e0..e{d-1}."""
    emb = load_table(spark, sf_dir, "embeddings")
    d = len(emb.select("embedding").first()[0])
    cols = [f"e{i}" for i in range(d)]
    return emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c)
                                           for i, c in enumerate(cols)]), cols


def line_regression_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        "l_extendedprice", "l_quantity", "p_retailprice", "l_discount", "l_tax")
