"""Scores, reports and comparisons of labelled predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy_of(label: Column, prediction: Column) -> Column:
    return F.avg(F.when(label == prediction, 1.0).otherwise(0.0))


def accuracy_table(df: DataFrame, label: str, voters: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, voter, score`` for several prediction columns in one pass."""
    scored = df.groupBy(*by).agg(
        F.array(*[F.struct(F.lit(v).alias("voter"), accuracy_of(F.col(label), F.col(v)).alias("score")) for v in voters]).alias("s")
    )
    return scored.select(*by, F.inline("s"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages.

    Everything follows from the confusion counts, a table of classes squared.
    """
    confusion = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    entries = F.array(
        F.struct(F.col(label).alias("class"), hit.alias("hits"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    sums = (
        confusion.select(F.inline(entries))
        .groupBy("class")
        .agg(F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    per_class = sums.select("class", "hits", "support", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )

    def mean(name: str, weighted: bool) -> Column:
        if weighted:
            return F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support"))
        return F.avg(name)

    def overall(title: str, weighted: bool):
        return F.struct(
            F.lit(title).alias("class"),
            *[mean(m, weighted).alias(m) for m in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        )

    hits = F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double"))
    share = F.struct(
        F.lit("accuracy").alias("class"), *[hits.alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support")
    )
    summary = per_class.agg(F.array(share, overall("macro avg", False), overall("weighted avg", True)).alias("rows"))
    return per_class.select("class", "precision", "recall", "f1", "support").unionByName(summary.select(F.inline("rows")))


def leaderboard(scores: DataFrame, score: str = "score") -> DataFrame:
    """Rank by descending score. Takes one row per configuration, never data rows."""
    return scores.withColumn("place", F.rank().over(Window.orderBy(F.desc(score))))


def against_baseline(scores: DataFrame, name: str, baseline: str, score: str = "score") -> DataFrame:
    base = scores.where(F.col(name) == baseline).agg(F.max(score).alias("base")).scalar()
    return scores.withColumn("gain", F.col(score) - base).withColumn("gain_pct", F.try_divide(F.col(score) - base, base) * 100)


def verdict(gain: Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First text whose limit the gain exceeds; limits in descending order."""
    out = None
    for limit, text in limits:
        out = F.when(gain > limit, text) if out is None else out.when(gain > limit, text)
    return out.otherwise(otherwise)
