"""Evaluation (E1-E4, W6): metrics as aggregates over (label, prediction)
or (label, score) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long ``(label, prediction, n)`` completed with zero cells over the
    union of observed classes (a bounded list)."""
    d = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    classes = sorted({r[0] for r in d.select("label").union(d.select("prediction")).distinct().collect()
                      if r[0] is not None})
    obs = d.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    arr = F.array(*[F.lit(c) for c in classes])
    grid = obs.sparkSession.range(1).select(F.explode(arr).alias("label")).select(
        "label", F.explode(arr).alias("prediction"))
    return grid.join(obs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0/0 → 0)."""
    cm = confusion_matrix(df, label, prediction)
    per = cm.groupBy("label").agg(F.sum("n").alias("support"),
                                  F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))).alias("tp"))
    pred = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    j = per.join(pred, "label", "full").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    n = F.sum("support")
    return j.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(prec * F.col("support")) / n).alias("precision"),
        (F.sum(rec * F.col("support")) / n).alias("recall"),
        (F.sum(f1 * F.col("support")) / n).alias("f1"),
        n.alias("n"))


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    pos = (F.col(label) == F.lit(positive)).cast("long")
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """ROC points per distinct threshold (descending): cumulative true and
    false positives over a global order without a single-partition window."""
    sc = _score_counts(df, label, score, positive)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    cum = ordering.global_cumsum(sc, "score", ["pos", "neg"], descending=True)
    return cum.select(F.col("score").alias("threshold"),
                      F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      (F.col("cum_pos") / F.lit(P) if P else F.lit(None).cast("double")).alias("tpr"),
                      (F.col("cum_neg") / F.lit(N) if N else F.lit(None).cast("double")).alias("fpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Exact AUC with tied scores counted half (Mann-Whitney form):
    Σ_s pos_s (neg_below_s + neg_s / 2) / (P N)."""
    sc = _score_counts(df, label, score, positive)
    cum = ordering.global_cumsum(sc, "score", ["neg"], descending=False)
    below = F.col("cum_neg") - F.col("neg")
    agg = cum.agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("u"),
                  F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select((F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def macro_ovr_auc(df: DataFrame, label: str, prob_cols: dict) -> float | None:
    """Macro one-vs-rest AUC over classes given per-class score columns."""
    vals = []
    for cls, col in prob_cols.items():
        r = roc_auc(df, label, col, cls).first()
        if r and r["auc"] is not None:
            vals.append(r["auc"])
    return sum(vals) / len(vals) if vals else None


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, R² in one aggregate."""
    err = F.col(label) - F.col(prediction)
    a = df.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
               F.var_pop(label).alias("_vy"), F.count(F.lit(1)).alias("n"))
    return a.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("_vy") > 0, 1 - F.col("mse") / F.col("_vy")).alias("r2"), "n")
