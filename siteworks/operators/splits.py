"""Stratified splits and folds, fixed by a row hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.operators.joins import measured
from siteworks.operators.ordering import hash_cutoffs, row_hash


def _cut_at(share: float):
    return lambda n: F.round(n.cast("double") * F.lit(share))


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int, name: str = "split") -> DataFrame:
    """Mark round(n_class * fraction) rows of each class ``validation``, the rest ``train``.

    The rows themselves are not moved: they are compared with one cut-off hash
    per class.
    """
    hashed = df.withColumn("h", row_hash(F.col(key), seed))
    cutoffs = hash_cutoffs(hashed, [label], [_cut_at(fraction)])
    chosen = F.when(F.col("h") <= F.col("cutoffs")[0], "validation").otherwise("train")
    return hashed.join(measured(cutoffs), label).withColumn(name, chosen).drop("h", "n", "cutoffs")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Folds 0..k-1; within a class their sizes differ by at most one."""
    hashed = df.withColumn("h", row_hash(F.col(key), seed))
    cuts = [lambda n, i=i: F.floor(n * F.lit(i) / F.lit(folds)) for i in range(1, folds)]
    cutoffs = hash_cutoffs(hashed, [label], cuts)
    fold = F.size(F.filter("cutoffs", lambda c: c < F.col("h")))
    return hashed.join(measured(cutoffs), label).withColumn(name, fold).drop("h", "n", "cutoffs")


def learning_curve_samples(
    df: DataFrame, key: str, label: str, sizes: Sequence[float], seeds: Sequence[int]
) -> DataFrame:
    """Per seed, the smallest of the nested stratified sub-samples each row is in.

    Rows in none of them are left out. ``size <= s`` selects the sample of size s.
    """
    ordered = sorted(sizes)
    seeded = df.select(key, label, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    hashed = seeded.withColumn("h", row_hash(F.col(key), F.col("seed")))
    cutoffs = hash_cutoffs(hashed, ["seed", label], [_cut_at(s) for s in ordered])
    place = F.size(F.filter("cutoffs", lambda c: c < F.col("h")))
    size = F.array(*[F.lit(float(s)) for s in ordered])
    return (
        hashed.join(measured(cutoffs), ["seed", label])
        .withColumn("place", place)
        .where(F.col("place") < len(ordered))
        .select(key, label, "seed", F.element_at(size, F.col("place") + 1).alias("size"))
    )


def split_balance(split: DataFrame, label: str, name: str = "split") -> DataFrame:
    counts = split.groupBy(name, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(name).agg(F.sum("n").alias("total"))
    return counts.join(totals, name).select(name, label, "n", (F.col("n").cast("double") / F.col("total")).alias("share"))
