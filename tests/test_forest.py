"""Forests that grow in tasks on a table of bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteworks.operators import forest, models


@pytest.fixture(scope="module")
def table(spark):
    """Two numbers decide the class, a third says nothing; one row in ten has any class."""
    n = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    kind = F.when(n % 10 == 0, F.pmod(F.xxhash64(n, F.lit(1)), F.lit(3))).otherwise((F.col("a") > 400).cast("int") + (F.col("b") > 2).cast("int"))
    rows = spark.range(3000).select("id", (n * 37 % 1009).cast("double").alias("a"), (n % 5).cast("double").alias("b"), noise.alias("c"))
    rows = rows.withColumn("status_group", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), kind.cast("int") + 1))
    return models.ExperimentTable(rows.withColumn("part", n % 4), ["a", "b", "c"])


def cut():
    return {"train": F.col("part") < 3, "held": F.col("part") == 3}


def test_a_forest_on_bytes_scores_as_mllib_does(table, monkeypatch):
    settings = dict(trees=20, depth=8, seed=3)
    ours = table.fit(cut()["train"], ["a", "b", "c"], models.random_forest(**settings))
    got = table.scores(ours, **cut(), none=F.lit(False))
    assert isinstance(ours, forest.TableForest) and got == table.scores(ours, **cut(), none=F.lit(False))
    monkeypatch.setattr(forest, "fits_here", lambda estimator: False)
    theirs = table.scores(table.fit(cut()["train"], ["a", "b", "c"], models.random_forest(**settings)), **cut(), none=F.lit(False))
    assert got["none"] == theirs["none"] == (0, None, None)
    for part in ("train", "held"):
        assert got[part][0] == theirs[part][0] and got[part][2] == pytest.approx(theirs[part][2])
        assert got[part][1] == pytest.approx(theirs[part][1], abs=0.03) and got[part][1] > 0.85


def test_large_tables_stay_with_mllib(spark, monkeypatch):
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 39)
    rows = spark.range(10).select("id", F.col("id").cast("double").alias("a"), F.lit("x").alias("status_group"))
    assert forest.byte_table(models.training_rows(rows), 3, 1) is None
    assert models.ExperimentTable(rows, ["a"]).bytes() is not None
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 19)
    few = models.ExperimentTable(rows, ["a"])
    assert few.bytes() is None and few.at_once(models.random_forest()) == 4


def test_one_fit_is_few_jobs_however_deep_its_trees(spark, table):
    """MLlib takes a job and more for each level."""
    table.bytes()
    spark.sparkContext.setJobGroup("deep", "one fit")
    table.scores(table.fit(cut()["train"], ["a", "b", "c"], models.random_forest(100, depth=30)), **cut())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("deep")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 6


def test_other_settings_stay_with_mllib():
    assert forest.fits_here(models.random_forest()) and forest.fits_here(models.random_forest(bootstrap=False))
    for other in (models.random_forest(weight="w"), models.random_forest(maxBins=64), models.random_forest(impurity="entropy"), models.random_forest(featureSubsetStrategy="all"), models.boosted_trees()):
        assert not forest.fits_here(other)


def test_rows_without_a_forest_are_an_error(table):
    with pytest.raises(ValueError):
        table.scores(table.fit(F.lit(False), ["a"], models.random_forest(5)), **cut())


def test_bins_keep_all_of_a_few_values_and_quantiles_of_many(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(20_000).select(array_to_vector(F.array((F.col("id") == 7).cast("double"), F.col("id").cast("double"), F.lit(1.0))).alias("features"))
    flag, many, same = forest.bin_edges(rows, 3)
    assert flag == [0.0] and same == [] and len(many) == 255
    assert max(abs(e - 20_000 * (i + 1) / 256) for i, e in enumerate(many)) < 20
    codes = np.stack([np.repeat(np.arange(256), 10), np.repeat([0, 9, 200, 255], 640)]).astype(np.uint8)
    bins = forest.own_bins(codes)
    assert bins[0].tolist() == [c // 8 for c in range(256)] and bins[1][[0, 9, 200, 255]].tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_trees_equal_a_plain_search(at_once, monkeypatch):
    """Without bootstrap and with one feature a tree is fixed: each node takes the cut of most Gini gain."""
    monkeypatch.setattr(forest, "NODES_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 32, (1, 400)).astype(np.uint8), rng.integers(0, 3, 400).astype(np.uint8)
    grown = forest.grow(x, y, 3, 2, 4, False, rng)
    votes = np.zeros((400, 3))
    forest.add_votes(grown, x, np.arange(400), votes)

    def plain(of, depth):
        n = np.bincount(y[of], minlength=3)
        gini = lambda part: len(part) - (np.bincount(y[part], minlength=3) ** 2).sum() / len(part)
        cuts = [(gini(of[x[0, of] <= c]) + gini(of[x[0, of] > c]), c) for c in range(31) if 0 < (x[0, of] <= c).sum() < len(of)]
        if depth == 4 or not cuts or min(cuts)[0] >= gini(of) - 1e-9:
            return {i: n / n.sum() for i in of}, True, n.argmax()
        c = min(cuts)[1]
        (left, l_leaf, l_is), (right, r_leaf, r_is) = plain(of[x[0, of] <= c], depth + 1), plain(of[x[0, of] > c], depth + 1)
        if l_leaf and r_leaf and l_is == r_is:
            return {i: n / n.sum() for i in of}, True, l_is
        return left | right, False, None

    want, _, _ = plain(np.arange(400), 0)
    assert np.allclose(votes, 2 * np.array([want[i] for i in range(400)]))
