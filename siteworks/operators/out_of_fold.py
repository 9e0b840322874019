"""Statistics that never see the held-out fold, for all folds in one pass.

A group's sums over the rows outside a fold are its sums over all rows minus those over the
fold's own rows. So one aggregation gives the statistics of every fold, and rows are joined
with them once: a list with one entry per fold. Neighbours work alike: a list somewhat longer than asked is
searched once, and what a fold must not see is struck from it. Only rows whose list gets too short
that way are searched again, among the rows outside that fold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteworks.operators.groups import POSITIVE, join_back, weighted_median
from siteworks.operators.spatial import located, nearest_neighbors
from siteworks.session import materialize, materialize_counted


def out_of_fold_sums(df: DataFrame, key: str, fold: str, folds: int, sums: Mapping[str, Column]) -> DataFrame:
    """``key, <name>...``: per non-null key a list for each sum, whose entry ``f`` leaves out the rows of fold ``f``.

    Nulls add nothing. Partial sums are combined before the shuffle: a group of any size sends a row per task.
    """
    known = df.where(F.col(key).isNotNull())
    value = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    parts = {
        name: F.struct(F.sum(value(c)).alias("all"), F.array(*[F.sum(F.when(F.col(fold) == f, value(c)).otherwise(0.0)) for f in range(folds)]).alias("own"))
        for name, c in sums.items()
    }
    grouped = known.groupBy(key).agg(*[c.alias(name) for name, c in parts.items()])
    outside = lambda name: F.transform(f"{name}.own", lambda own: F.col(f"{name}.all") - own).alias(name)
    return grouped.select(key, *[outside(name) for name in sums])


def out_of_fold_ward_statistics(df: DataFrame, fold: str, folds: int, key: str = "ward") -> DataFrame:
    """``df`` with lists ``ward_site_count`` and ``ward_functional_ratio``: entry ``f`` is fitted on the rows outside fold ``f``.

    As with a reference table, gaps take the median count of the wards seen and 0.5. A ward whose rows all lie in a fold is a gap for it.
    """
    sums = {"seen": F.lit(1), "sites": F.col("latitude").isNotNull().cast("int"), "hits": (F.col("status_group") == POSITIVE).cast("int")}
    stats = materialize(out_of_fold_sums(df, key, fold, folds, sums))
    middles = [weighted_median(stats.where(F.col("seen")[f] > 0).select(F.col("sites")[f].alias("n")), "n", F.lit(1)).scalar() for f in range(folds)]
    entry = lambda f, c: F.when(F.col("seen")[f] > 0, c)
    known = stats.select(
        key,
        F.array(*[entry(f, F.col("sites")[f]) for f in range(folds)]).alias("fold_counts"),
        F.array(*[entry(f, F.col("hits")[f] / F.col("seen")[f]) for f in range(folds)]).alias("fold_rates"),
    )
    joined = join_back(df, known, [key])
    counts = F.array(*[F.coalesce(F.col("fold_counts")[f], middles[f]) for f in range(folds)])
    rates = F.array(*[F.coalesce(F.col("fold_rates")[f], F.lit(0.5)) for f in range(folds)])
    return joined.withColumns({"ward_site_count": counts, "ward_functional_ratio": rates}).drop("fold_counts", "fold_rates")


def out_of_fold_neighbor_rate(df: DataFrame, fold: str, folds: int, k: int = 10, spare: int | None = None) -> DataFrame:
    """``id, neighbor_functional_ratio``: a list whose entry ``f`` is the share among the k nearest other rows outside fold ``f``.

    ``spare`` more neighbours than k are searched at first (k by default). Rows without coordinates have no entry here; where a fold leaves
    no neighbour at all, the entry is 0.5.
    """
    wide = k + (k if spare is None else spare)
    rows = materialize(located(df).select("id", "latitude", "longitude", F.col(fold).alias("fold"), (F.col("status_group") == POSITIVE).alias("hit")))
    marks = rows.select(F.col("id").alias("nbr_id"), F.col("fold").alias("nbr_fold"), F.coalesce(F.col("hit").cast("double"), F.lit(0.0)).alias("nbr_hit"))

    near = nearest_neighbors(rows, wide).join(marks, "nbr_id")
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr_fold", "nbr_hit"))).alias("near"))
    lists = materialize(rows.select("id").join(lists, "id", "left").select("id", F.coalesce("near", F.array().cast("array<struct<rank:int,nbr_fold:int,nbr_hit:double>>")).alias("near")))
    whole = F.size("near") < wide  # fewer rows than asked for: nothing is beyond the list

    def entry(f: int) -> Column:
        kept = F.slice(F.filter("near", lambda x: x["nbr_fold"] != f), 1, k)
        rate = F.aggregate(kept, F.lit(0.0), lambda total, x: total + x["nbr_hit"]) / F.size(kept)
        return F.when(F.size(kept) == 0, F.when(whole, F.lit(0.5))).when((F.size(kept) >= k) | whole, rate)

    rates = materialize(lists.select("id", F.array(*[entry(f) for f in range(folds)]).alias("rates")))
    found = None
    for f in range(folds):
        short, n = materialize_counted(rows.join(rates.where(F.col("rates")[f].isNull()).select("id"), "id", "left_semi"))
        if not n:
            continue
        outside = rows.where(F.col("fold") != f)
        # One more than asked: a row outside the fold meets itself.
        again = nearest_neighbors(short, k + 1, outside).where("nbr_id <> id").join(marks.drop("nbr_fold"), "nbr_id")
        first = again.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "nbr_hit"))), 1, k).alias("near"))
        rate = first.select("id", F.lit(f).alias("fold"), (F.aggregate("near", F.lit(0.0), lambda total, x: total + x["nbr_hit"]) / F.size("near")).alias("rate"))
        found = rate if found is None else found.unionByName(rate)
    if found is not None:
        more = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("fold", "rate"))).alias("more"))
        rates = rates.join(more, "id", "left").select("id", F.transform("rates", lambda x, f: F.coalesce(x, F.col("more")[f])).alias("rates"))
    return rates.select("id", F.transform("rates", lambda x: F.coalesce(x, F.lit(0.5))).alias("neighbor_functional_ratio"))
