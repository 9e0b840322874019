"""How rows are dealt to learners."""

import pytest

from siteworks.operators import models
from siteworks.plans import modelling


def test_tree_learners_get_all_rows_in_few_partitions(spark):
    rows = spark.range(0, 12_000, 1, 12)
    few = models.tree_rows(rows)
    assert few.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    assert few.count() == 12_000 and few.distinct().count() == 12_000
    assert models.tree_rows(rows.where("id < 10")).rdd.getNumPartitions() == 1
    assert models.tree_rows(rows.where("id < 0")).count() == 0


def test_tasks_of_tree_learners_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_TREE_ROWS", 1_000)
    assert models.tree_rows(spark.range(0, 40_000, 1, 60)).rdd.getNumPartitions() == 40


def test_learners_that_grow_trees_are_told_from_others():
    trees = [models.random_forest(), models.boosted_trees()]
    assert all(map(models._grows_trees, trees)) and models.random_forest().getCacheNodeIds()
    assert not any(map(models._grows_trees, [models.logistic_regression(), models.neural_net(3)]))


@pytest.mark.parametrize("learner", [lambda: models.neural_net(1), models.logistic_regression], ids=["neural_net", "logistic_regression"])
def test_learners_that_pass_over_all_rows_get_few_partitions(spark, monkeypatch, learner):
    """Every pass of L-BFGS sends weights to, and a gradient from, each partition."""
    seen = []

    class Pipeline:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count(), rows.distinct().count()))

    monkeypatch.setattr(models, "Pipeline", Pipeline)
    cores = spark.sparkContext.defaultParallelism
    models.fit_model(spark.range(0, 12_000, 1, 60), ["id"], learner())
    assert seen == [(min(3, cores), 12_000, 12_000)]
    models.fit_model(spark.range(0, 0, 1, 60), ["id"], learner())
    assert seen[1][1:] == (0, 0)


def test_passes_have_no_last_round_of_few_tasks(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "LEAST_TREE_ROWS", 10)
    monkeypatch.setattr(models, "MOST_TREE_ROWS", 100)
    rows = spark.range(0, 100 * cores + 1, 1, 5 * cores)
    assert models.pass_rows(rows).rdd.getNumPartitions() == 2 * cores
    assert models.pass_rows(rows).count() == 100 * cores + 1


def test_features_are_not_computed_by_the_tasks_that_read_the_table(spark, monkeypatch):
    """A small file is one task; its rows are spread before anything is computed of them."""
    monkeypatch.setattr(modelling, "sites", lambda spark, sf: spark.range(0, 1000, 1, 1))
    parts = []

    def stop(rows):
        parts.append((rows.rdd.getNumPartitions(), rows.count()))
        raise StopIteration

    monkeypatch.setattr(modelling, "split_of", stop)
    with pytest.raises(StopIteration):
        modelling.prepared(spark, "", [])
    assert parts == [(int(spark.conf.get("spark.sql.shuffle.partitions")), 1000)]
