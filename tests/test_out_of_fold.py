"""Statistics outside a fold against a search per fold; model tests that a constant model fails."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siteworks.operators import out_of_fold as oof
from siteworks.plans import modelling

KIND = "id long, latitude double, longitude double, ward string, status_group string, fold int"
FOLDS = 3


def rows(seed, folds_by_place=False):
    rng = random.Random(seed)
    out = []
    for i in range(160):
        lat, lon = round(rng.uniform(-5, 5), 2), round(rng.uniform(30, 35), 2)
        if i % 17 == 0:
            lat, lon = 1.0, 31.0  # one spot
        if i % 23 == 0:
            lat = None if i % 2 else 0.0
        # Folds that are regions: nearly all neighbours of a row share its fold.
        fold = (0 if lat is None or lat < -2 else 1 if lat < 2 else 2) if folds_by_place else rng.randrange(FOLDS)
        out.append((i, lat, lon, rng.choice(["a", "b", "c", None, f"own{fold}"]), rng.choice(["functional", "non functional", None]), fold))
    return out


def km(a, b):
    la, lo, lb, lob = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return round(2 * 6371 * math.asin(math.sqrt(h)), 9)


def hit(r):
    return r[4] == "functional"


def known(r):
    return r[1] not in (None, 0.0) and r[2] not in (None, 0.0)


@pytest.mark.parametrize("by_place", [False, True])
@pytest.mark.parametrize("spare", [0, None])
def test_neighbours_outside_each_fold(spark, by_place, spare):
    data = rows(1, by_place)
    got = {r.id: r.neighbor_functional_ratio for r in oof.out_of_fold_neighbor_rate(spark.createDataFrame(data, KIND).repartition(3), "fold", FOLDS, 5, spare).collect()}
    located = [r for r in data if known(r)]
    assert set(got) == {r[0] for r in located}
    for r in located:
        for f in range(FOLDS):
            near = sorted((km(r, o), o[0], hit(o)) for o in located if o[0] != r[0] and o[5] != f)[:5]
            assert got[r[0]][f] == pytest.approx(sum(h for *_, h in near) / len(near)), (r, f)


def test_few_rows(spark):
    data = [(1, 1.0, 30.0, "a", "functional", 0), (2, 1.1, 30.0, "a", None, 0), (3, 1.2, 30.0, "b", "functional", 1)]
    got = {r.id: r.neighbor_functional_ratio for r in oof.out_of_fold_neighbor_rate(spark.createDataFrame(data, KIND), "fold", 2, 5).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [0.5, 0.5]}


def test_wards_outside_each_fold(spark):
    data = rows(2)
    got = {r.id: r for r in oof.out_of_fold_ward_statistics(spark.createDataFrame(data, KIND).repartition(3), "fold", FOLDS).collect()}
    assert len(got) == len(data)
    for f in range(FOLDS):
        wards = {}
        for r in data:
            if r[5] != f and r[3] is not None:
                wards.setdefault(r[3], []).append(r)
        counts = sorted(sum(r[1] is not None for r in w) for w in wards.values())
        middle = (counts[(len(counts) - 1) // 2] + counts[len(counts) // 2]) / 2
        for r in data:
            w = wards.get(r[3])
            assert got[r[0]].ward_site_count[f] == (sum(x[1] is not None for x in w) if w else middle)
            assert got[r[0]].ward_functional_ratio[f] == pytest.approx(sum(map(hit, w)) / len(w) if w else 0.5)


def predictions(spark, label):
    data = [(i, "functional" if i % 3 else "non functional", "validation" if i % 4 == 0 else "train") for i in range(800)]
    return spark.createDataFrame(data, "id long, status_group string, split string").withColumn("prediction_label", label)


def test_constant_and_wrong_models_fail(spark):
    """What the registered model queries say of a model: one that always answers one class, or answers by chance, does not pass."""
    test = lambda label: {r.beats_majority for r in modelling.held_rows(predictions(spark, label)).collect()}
    assert test(F.lit("functional")) == {False} and test(F.lit("non functional")) == {False}
    assert test(F.when(F.col("id") % 2 == 0, "functional").otherwise("non functional")) == {False}
    learned_by_heart = F.when(F.col("split") == "train", F.col("status_group")).otherwise("functional")
    assert test(learned_by_heart) == {False}
    assert test(F.when(F.col("id") % 50 == 0, "functional").otherwise(F.col("status_group"))) == {True}
