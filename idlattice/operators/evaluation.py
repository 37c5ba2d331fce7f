"""Calibration of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def calibration(samples: DataFrame, threshold: float = 0.35, strict: bool = True) -> DataFrame:
    """samples (positive boolean, score) -> one row: counts, means, confusion matrix, rates."""
    over = F.col("score") > threshold if strict else F.col("score") >= threshold
    pos = F.col("positive")
    counts = samples.agg(F.count_if(~pos).alias("n_clean"), F.count_if(pos).alias("n_tampered"), F.coalesce(F.round(F.avg(F.when(~pos, F.col("score"))), 4), F.lit(0.0)).alias("mean_clean"), F.coalesce(F.round(F.avg(F.when(pos, F.col("score"))), 4), F.lit(0.0)).alias("mean_tampered"), F.count_if(~pos & ~over).alias("tn"), F.count_if(~pos & over).alias("fp"), F.count_if(pos & ~over).alias("fn"), F.count_if(pos & over).alias("tp"))
    c = F.col
    precision, recall = _rate(c("tp"), c("tp") + c("fp")), _rate(c("tp"), c("tp") + c("fn"))
    rates = {"fpr": _rate(c("fp"), c("n_clean")), "fnr": _rate(c("fn"), c("n_tampered")), "precision": precision, "recall": recall, "f1": _rate(2 * precision * recall, precision + recall)}
    return counts.withColumns({k: F.round(v, 4) for k, v in rates.items()})


def level_histogram(samples: DataFrame) -> DataFrame:
    """samples (positive, level) -> positive, LOW, MEDIUM, HIGH."""
    return samples.groupBy("positive").agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH")])


def acceptance_rates(pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """pairs (genuine boolean, score) -> one row: means, separation, false acceptance and rejection."""
    g = F.col("genuine")
    hit = F.col("score") >= threshold
    per = pairs.agg(F.count_if(g).alias("n_genuine"), F.count_if(~g).alias("n_impostor"), F.coalesce(F.avg(F.when(g, F.col("score"))), F.lit(0.0)).alias("mg"), F.coalesce(F.avg(F.when(~g, F.col("score"))), F.lit(0.0)).alias("mi"), F.count_if(~g & hit).alias("false_accepts"), F.count_if(g & ~hit).alias("false_rejects"))
    return per.select("n_genuine", "n_impostor", F.round("mg", 4).alias("mean_genuine"), F.round("mi", 4).alias("mean_impostor"), F.round(F.col("mg") - F.col("mi"), 4).alias("separation"), "false_accepts", "false_rejects", F.round(F.col("false_accepts") / F.greatest(F.lit(1), F.col("n_impostor")), 4).alias("far"), F.round(F.col("false_rejects") / F.greatest(F.lit(1), F.col("n_genuine")), 4).alias("frr"))
