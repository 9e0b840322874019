"""Bitmaps of ids against Python sets."""

import random

import pytest

from siteworks.operators import id_sets


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "k long").repartition(3)


def got(df):
    rows = [r.k for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def two():
    rng = random.Random(3)
    edges = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 65537, 2**40, -(2**40), 2**62]
    left = [rng.randint(-70_000, 140_000) for _ in range(3000)] + edges + edges + [None, None]
    right = [x for x in left[:1500] if x % 3] + [rng.randint(60_000, 200_000) for _ in range(800)] + edges[::2] + [None]
    return left, right


def test_operations_equal_sets(spark, two):
    left, right = two
    a, b = ({x for x in s if x is not None} for s in two)
    one, other = (id_sets.bitmaps(frame(spark, s), "k") for s in (left, right))
    assert got(id_sets.ids_of(one, "k")) == a
    assert got(id_sets.difference(one, other, "k")) == a - b and got(id_sets.difference(other, one, "k")) == b - a
    assert got(id_sets.intersection(one, other, "k")) == a & b
    assert got(id_sets.ids_of(id_sets.merged(one, other), "k")) == a | b
    assert tuple(id_sets.overlap(one, other).first()) == (len(a), len(b), len(a & b))
    assert id_sets.size(one).first().n == len(a)


def test_empty_sets(spark, two):
    one, none = id_sets.bitmaps(frame(spark, two[0]), "k"), id_sets.bitmaps(frame(spark, []), "k")
    a = {x for x in two[0] if x is not None}
    assert got(id_sets.difference(one, none, "k")) == a and got(id_sets.difference(none, one, "k")) == set()
    assert tuple(id_sets.overlap(one, none).first()) == (len(a), 0, 0) and id_sets.size(none).first().n == 0


def test_dense_and_sparse_ids_give_the_same_list(spark):
    rng = random.Random(4)
    for ids in (list(range(5000)), [rng.randrange(2**60) for _ in range(300)]):
        done = ids[::2] + [None]
        source = frame(spark, ids + ids[:50] + [None])
        assert id_sets.dense_enough(source, "k") == (len(ids) == 5000)
        assert got(id_sets.missing_ids(source, frame(spark, done), "k")) == set(ids[1::2])


def test_few_rows_are_shuffled(spark):
    """A row per bucket, not per id, is what the exchange gets."""
    ids = spark.range(200_000).selectExpr("id as k").union(spark.range(200_000).selectExpr("id as k"))
    assert id_sets.bitmaps(ids, "k").count() == 8
