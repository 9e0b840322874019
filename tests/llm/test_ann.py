"""Forest search against brute force."""

from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteworks.llm.ann import Forest, search_vectors

SCHEMA = "vec_id long, embedding array<float>, leaf int"


def brute(rows, asked, k=5):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ids = sorted(good)
    data = np.array([good[i] for i in ids])
    size = np.sqrt((data * data).sum(axis=1))
    out = {}
    for q in ids:
        if asked(q):
            score = (data * good[q]).sum(axis=1) / (np.sqrt((good[q] * good[q]).sum()) * size)
            out[q] = [(ids[n], score[n]) for n in sorted((n for n in range(len(ids)) if ids[n] != q), key=lambda n: (-score[n], ids[n]))[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)


def test_exact_when_all_leaves_are_read(spark, monkeypatch):
    monkeypatch.setattr(Forest, "measured_reach", lambda *_: 10**9)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(300)] + [(2000 + i, (2 * np.array(rows[40][1], np.float32)).tolist()) for i in range(3)]
    rows += [(5000, None), (5010, []), (5020, [0.0] * 16), (5030, [None] * 16), (5040, [float("nan")] * 16), (5050, [float("inf")] * 16), (5060, [1.0]), (None, rows[0][1])]
    rows.append(rows[60])
    got = {}
    for r in search_vectors(table(spark, rows), F.col("vec_id") % 10 == 0, leaf_rows=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, lambda q: q % 10 == 0)


def hits(spark, frame, step, **options):
    """Nearest rows found, and how many there are."""
    rows = frame.select("vec_id", "embedding").collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    got = {}
    for r in search_vectors(frame, F.col("vec_id") % step == 0, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for n in np.flatnonzero(ids % step == 0):
        score = unit @ unit[n]
        score[n] = -2
        found += len(got[ids[n]] & set(ids[np.argsort(-score)[:5]].tolist()))
        assert len(got[ids[n]]) == 5
    return found, 5 * len(got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    found, of = hits(spark, spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), 50)
    assert found >= 0.9 * of


@pytest.mark.parametrize("leaf_rows", [32, 128, 512])
@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_does_not_depend_on_the_size_of_leaves(spark, leaf_rows, clusters):
    """Vectors without structure and in clusters, with many queries: the measured reach finds what it promises, within noise."""
    rng = np.random.default_rng(6)
    data = rng.standard_normal((4000, 32)) * (0.4 if clusters else 1) + (rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 4000)] if clusters else 0)
    frame = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(4)
    found, of = hits(spark, frame, 10, leaf_rows=leaf_rows)
    assert found >= 0.94 * of


def test_reach_follows_the_data():
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    plain = unit(rng.standard_normal((4000, 32)))
    close = unit(rng.standard_normal((80, 32))[rng.integers(0, 80, 4000)] + 0.1 * rng.standard_normal((4000, 32)))
    reach = [Forest(x, 6, 4).measured_reach(x, 5, 0.97) for x in (plain, close)]
    assert 1 <= reach[1] < reach[0] / 2 <= 128 and Forest(plain, 0, 4).measured_reach(plain, 5, 0.97) == 1


def test_queue_is_shared_and_ordered():
    rng = np.random.default_rng(3)
    data = rng.standard_normal((3000, 8))
    forest = Forest(data, 5, 3)
    leaves = forest.leaves(data)
    sizes = np.bincount(leaves[:, 0], minlength=32)
    assert sizes.min() > 60 and sizes.max() < 130
    found = list(islice(forest.search(data[0]), 200))
    assert set(found[:3]) == {(t, leaves[0, t]) for t in range(3)} and len(set(found)) == 96
    assert len({t for t, _ in found[:20]}) > 1
    deep = Forest(data[:20], 9, 1)
    assert deep.leaves(data).max() < 512


def test_odd_tables(spark):
    every = F.lit(True)
    assert search_vectors(table(spark, []), every).collect() == []
    assert search_vectors(table(spark, [(1, [1.0, 2.0])]), every).collect() == []
    got = search_vectors(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 1.0])]), every).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
