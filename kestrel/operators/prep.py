"""Model preparation (P12-P16): feature selection, standardisation with
the population deviation, deterministic hash splits, label encoding."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import numeric_columns

SEED = 42
TEST_FRACTION = 0.2
_BUCKET_HEX = 4  # split buckets: first 4 hex digits of the md5 order key
RANKED_ROWS = 1 << 20  # of more rows only the bucket that holds the cut is ranked


def validate_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in data: {missing}")


def default_features(df: DataFrame, target: str | None = None, exclude=()) -> list[str]:
    """All numeric columns minus the target (the reference's default)."""
    return [c for c in numeric_columns(df) if c != target and c not in exclude]


def scaler_stats(df: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (one aggregate row).

    A column's own NULLs are left out, whatever the other columns hold."""
    cols = list(cols)
    r = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"m_{i}"], r[f"s_{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols, stats=None, suffix: str = "") -> DataFrame:
    """``(x - mean) / sd_pop``; a constant column becomes 0 (sklearn)."""
    stats = stats or scaler_stats(df, cols)
    out = df
    for c in cols:
        m, s = stats[c]
        s = s if s and s > 0 else 1.0
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(s))
    return out


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def _order_key(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def split_bucket(key: str, seed: int = SEED):
    """The bucket of ``hash_split`` as a number, to be kept with the rows."""
    return F.conv(F.substring(_order_key(key, seed), 1, _BUCKET_HEX), 16, 10).cast("int")


def hash_split(df: DataFrame, key: str, label: str | None = None, test_fraction: float = TEST_FRACTION,
               seed: int = SEED, bucket: str | None = None) -> DataFrame:
    """Add ``is_test``: per class (or overall) the ``ceil(f * n)`` rows with
    the smallest ``md5(key || ':seed')`` (then key) are the test set.

    Exact without sorting a class in one task: rows are bucketed by the
    first hex digits of the md5 (monotone in the order), bucket counts per
    class (a bounded table) give each bucket's offset, and only rows inside
    one bucket are ranked by a window. With a column ``bucket`` (of
    ``split_bucket``, no label) the bucket that the cut falls into is looked up
    first and ranked alone; no other row moves."""
    h = _order_key(key, seed)
    grp = [label] if label else []
    d = df.withColumn("_h", h).withColumn("_b", F.col(bucket) if bucket else F.substring("_h", 1, _BUCKET_HEX))
    counts = d.groupBy(*grp, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wb = (Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))).orderBy("_b")
    offsets = counts.select(
        *grp, "_b",
        F.coalesce(F.sum("_bn").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))).alias("_cn"))
    if label:
        small = offsets.groupBy(label).agg(F.min("_cn").alias("_cn"))
        too_small = small.filter(F.col("_cn") < 2).limit(1).collect()
        if too_small:
            raise ValueError(f"class {too_small[0][label]!r} has fewer than 2 rows; cannot stratify")
    if bucket:
        before = offsets.withColumn("_left", F.ceil(F.col("_cn") * F.lit(test_fraction)) - F.col("_off"))
        r = before.filter(F.col("_left") > 0).agg(F.max("_b").alias("b"), F.max_by("_left", "_b").alias("left")).first()
        cut, left = (-1, 0) if r["b"] is None else r
        sure = d.filter(F.col("_b") != cut).withColumn("is_test", F.col("_b") < cut)
        local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
        edge = d.filter(F.col("_b") == cut).withColumn("is_test", local <= left)
        return sure.unionByName(edge).drop("_h", "_b", bucket)
    if label is None:
        j = d.join(F.broadcast(offsets), "_b")
    else:  # NULL labels are a class of their own
        o = offsets.withColumnRenamed(label, "_label").withColumnRenamed("_b", "_ob")
        j = d.join(o, d[label].eqNullSafe(o["_label"]) & (d["_b"] == o["_ob"])).drop("_label", "_ob")
    local = F.row_number().over(Window.partitionBy(*grp, "_b").orderBy("_h", key))
    rank = F.col("_off") + local
    n_test = F.ceil(F.col("_cn") * F.lit(test_fraction))
    return j.withColumn("is_test", rank <= n_test).drop("_h", "_b", "_off", "_cn")


def label_encode(df: DataFrame, label: str, out: str = "label_index") -> tuple[DataFrame, list]:
    """Labels → 0..k-1 in sorted order (the class list is bounded by the
    number of classes and returned for decoding)."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect() if r[0] is not None]
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return df.withColumn(out, idx.cast("long")), classes


def label_decode(df: DataFrame, col: str, classes: list, out: str) -> DataFrame:
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.element_at(arr, F.col(col).cast("int") + 1))


def ceil_frac(n: int, f: float = TEST_FRACTION) -> int:
    return int(math.ceil(n * f))


def array_scaler(train: DataFrame, arr: str = "_x") -> tuple[list, list]:
    """Mean and population deviation of an array<double> column, from one
    vector ``Summarizer`` pass (deviation 0 → 1)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    v = train.select(array_to_vector(arr).alias("_v"))
    r = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = r["count"]
    scale = (n - 1) / n if n > 1 else 0.0
    mean = [float(x) for x in r["mean"]]
    sd = [math.sqrt(max(float(x) * scale, 0.0)) for x in r["variance"]]
    return mean, [s if s > 0 else 1.0 for s in sd]


def scale_array(df: DataFrame, mean, sd, arr: str = "_x", out: str = "features") -> DataFrame:
    """``(x - mean) / sd`` elementwise, as a vector column."""
    from pyspark.ml.functions import array_to_vector
    centred = F.zip_with(arr, F.array(*[F.lit(m) for m in mean]), lambda a, m: a - m)
    scaled = F.zip_with(centred, F.array(*[F.lit(s) for s in sd]), lambda a, s: a / s)
    return df.withColumn(out, array_to_vector(scaled))
