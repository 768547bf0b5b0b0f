"""The reference's end-to-end jobs (L1-L7) as functions over DataFrames and
paths. Sinks are Parquet unless CSV is asked for; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, basket, clean, influence
from ..operators.joins import semi_join
from ..sources import constants, excel, files


def store_day_cleaning(raw: DataFrame, order_by: list[str], out: str | None = None) -> DataFrame:
    """L1: coerce metrics, revenue >= 10, first row per (store, day)."""
    df = clean.clean_store_days(raw, order_by)
    if out:
        files.write_table(df, out)
    return df


def competitor_influence(facts: DataFrame, events: DataFrame, lead_days, gap_days, out: str | None = None,
                         formatted: bool = False) -> DataFrame:
    """L2: all (D, T) pairs in one job; the sink is partitioned by the
    parameters (one folder per pair, as the reference's one file per pair)."""
    rep = influence.influence_report(facts, events, influence.make_params(lead_days, gap_days))
    if formatted:
        rep = influence.format_report(rep)
    if out:
        files.write_table(rep, out, partition_by=["lead_days", "gap_days"])
    return rep


def merge_reports(spark: SparkSession, folder: str, out: str | None = None) -> tuple[DataFrame | None, list]:
    """L3: all report CSV files of a folder, tagged with their file name, and
    the files that could not be read with their errors."""
    df, failed = files.read_csv_folder(spark, folder, tag="period_tag")
    if df is not None and out:
        files.write_table(df, out, fmt="csv")
    return df, failed


def store_activity(deliveries: DataFrame) -> DataFrame:
    """L4: distinct products and delivered amount per store."""
    return aggregate.store_activity(deliveries).orderBy("store")


def basket_job(spark: SparkSession, path: str, tx_col: str, item_col: str, min_item_frequency: int = 5,
               **kw) -> basket.BasketResult:
    """CSV with the id kept as text → clean strings → mine."""
    raw = files.read_csv(spark, path)
    cleaned = clean.clean_strings(raw)
    return basket.market_basket_analysis(cleaned, tx_col, item_col, min_item_frequency=min_item_frequency, **kw)


def clean_and_merge_folder(spark: SparkSession, folder: str, out: str) -> list:
    """Every CSV and workbook of a folder → clean names and values →
    one merged table. Sources stay in place; failures are returned."""
    frames, failed = [], []
    csv_df, f1 = files.read_csv_folder(spark, folder)
    failed += f1
    if csv_df is not None:
        frames.append(csv_df)
    try:
        xl, f2 = excel.read_excel(spark, folder)
        failed += f2
        if xl.columns != ["source_file"]:
            frames.append(xl)
    except Exception as e:  # noqa: BLE001 - a folder without workbooks
        failed.append((folder, str(e)))
    if frames:
        merged = clean.clean_strings(clean.union_by_name(frames))
        files.write_table(merged, out)
    return failed


def product_lookup(spark: SparkSession, base_dir: str | None, items: DataFrame, item_col: str,
                   group: str = "weilong") -> DataFrame:
    """Base tables by name and a product-group membership join (item
    names cleaned on both sides)."""
    if base_dir:
        excel.load_base_tables(spark, base_dir)
    dim = constants.product_groups(spark).filter(F.col("product_group") == group)
    it = items.withColumn("_name", clean.tx.clean_value(F.col(item_col)))
    return semi_join(it, dim, it["_name"] == dim["product_name"]).drop("_name")
