"""Combining voters that sit in columns of one row: no shuffle at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label classes in code order.
CLASSES = ["functional", "functional needs repair", "non functional"]


# The weights used for soft voting and for label voting.
SOFT_WEIGHTS_3 = [0.4, 0.4, 0.2]
SOFT_WEIGHTS_4 = [0.35, 0.35, 0.15, 0.15]
LABEL_WEIGHTS = [2, 2, 1]


def label_code(c: Column) -> Column:
    out = F.when(c == CLASSES[0], 0)
    for code, name in enumerate(CLASSES[1:], start=1):
        out = out.when(c == name, code)
    return out


def label_name(code: Column) -> Column:
    out = F.when(code == 0, CLASSES[0])
    for value, name in enumerate(CLASSES[1:], start=1):
        out = out.when(code == value, name)
    return out


def health_score(c: Column) -> Column:
    """Ordinal label for correlations: 2 functional, 1 needs repair, 0 not."""
    return F.lit(2) - label_code(c)


def weighted_vote(votes: Sequence[Column], weights: Sequence[float]) -> Column:
    """Label with the largest total weight; ties go to the earliest voter."""
    totals = []
    for vote in votes:
        total = F.lit(0.0)
        for other, weight in zip(votes, weights):
            total = total + F.when(other == vote, F.lit(float(weight))).otherwise(0.0)
        totals.append(total)
    best = F.greatest(*totals)
    out = F.when(totals[0] == best, votes[0])
    for total, vote in zip(totals[1:], votes[1:]):
        out = out.when(total == best, vote)
    return out


def majority_vote(votes: Sequence[Column]) -> Column:
    return weighted_vote(votes, [1.0] * len(votes))


def ordinal_average(votes: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Weighted mean of the label codes, rounded half to even, as a label."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for vote, weight in zip(votes, weights):
        top = top + label_code(vote).cast("double") * weight
        bottom = bottom + weight
    return label_name(F.bround(F.round(top / bottom, 12)).cast("int"))


def blend(probabilities: Sequence[Sequence[Column]], weights: Sequence[float]) -> list[Column]:
    """Weighted sum per class over voters' class probabilities."""
    out = []
    for per_voter in zip(*probabilities):
        total = F.lit(0.0)
        for p, weight in zip(per_voter, weights):
            total = total + F.lit(float(weight)) * p
        out.append(total)
    return out


def best_class(scores: Sequence[Column], digits: int = 9) -> Column:
    """Class with the highest score; the lowest class wins a tie."""
    rounded = [F.round(s, digits) for s in scores]
    best = F.greatest(*rounded)
    out = F.when(rounded[0] == best, CLASSES[0])
    for score, name in zip(rounded[1:], CLASSES[1:]):
        out = out.when(score == best, name)
    return out


def voter_weights(scores: DataFrame, score: str = "score") -> DataFrame:
    total = scores.agg(F.sum(score).alias("total")).scalar()
    return scores.withColumn("weight", F.col(score) / total)
