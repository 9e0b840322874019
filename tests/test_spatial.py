import math

import numpy as np
import pandas as pd
import pytest

from siteworks.operators import spatial as sp


def assets(lat, lon):
    return pd.DataFrame({"id": np.arange(1, len(lat) + 1), "latitude": lat, "longitude": lon})


def brute(queries, k, reference=None):
    own = reference is None
    reference = queries if own else reference
    lat, lon = np.radians(reference.latitude.values), np.radians(reference.longitude.values)
    out = []
    for i, a, b in zip(queries.id, np.radians(queries.latitude), np.radians(queries.longitude)):
        h = np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2
        d = np.round(2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h))), 9)
        order = np.lexsort((reference.id.values, d))
        near = [reference.id.values[j] for j in order[: k + 1] if not own or reference.id.values[j] != i][:k]
        out += [(i, rank, n) for rank, n in enumerate(near, 1)]
    return out


def found(spark, queries, k, reference=None):
    ref = None if reference is None else spark.createDataFrame(reference)
    rows = sp.nearest_neighbors(spark.createDataFrame(queries), k, ref).collect()
    return sorted((r.id, r["rank"], r.nbr_id) for r in rows)


rng = np.random.default_rng(7)
CITY = assets(
    np.concatenate([rng.uniform(-80, 80, 100), -6 + rng.normal(0, 1e-4, 300), np.full(200, 10.5)]),
    np.concatenate([rng.uniform(-180, 180, 100), 35 + rng.normal(0, 1e-4, 300), np.full(200, 20.25)]),
)
EDGE = assets(rng.uniform(-5, 5, 200), np.where(rng.random(200) < 0.5, rng.uniform(178, 180, 200), rng.uniform(-180, -178, 200)))
TIES = assets(np.round(rng.uniform(60, 61, 300), 1), np.round(rng.uniform(10, 12, 300), 1))
FEW = assets(rng.uniform(-1, 1, 4), rng.uniform(1, 2, 4))


@pytest.mark.parametrize("rows,k", [(CITY, 10), (EDGE, 7), (TIES, 5), (FEW, 10)], ids=["city and one spot", "180 degrees", "ties", "fewer than k"])
def test_self_neighbors_equal_brute_force(spark, rows, k):
    assert found(spark, rows, k) == sorted(brute(rows, k))


def test_reference_neighbors_equal_brute_force(spark):
    asked = assets(rng.uniform(-10, 1, 200), rng.uniform(30, 40, 200))
    known = assets(np.concatenate([rng.normal(-6, 0.001, 300), rng.uniform(-40, 40, 30)]),
                   np.concatenate([rng.normal(36, 0.001, 300), rng.uniform(-100, 100, 30)]))
    assert found(spark, asked, 6, known) == sorted(brute(asked, 6, known))


def test_unlocated_rows_take_no_part(spark):
    rows = spark.createDataFrame([(1, 0.0, 30.0), (2, None, 31.0), (3, 5.0, 0.0)], "id bigint, latitude double, longitude double")
    assert sp.nearest_neighbors(rows, 3).count() == 0


def test_mean_pair_distance_is_within_its_bound(spark):
    lat, lon = rng.normal(-6, 0.5, 120), rng.normal(35, 2.0, 120)
    rows = assets(lat, lon).assign(g=np.where(np.arange(120) < 80, "a", "b"))
    rows.loc[len(rows)] = [999, 1.0, 1.0, "single"]
    rows["id"] = rows["id"].astype("int64")
    got = {r.g: r.mean_pair_distance for r in sp.mean_pair_distance(spark.createDataFrame(rows), "g").collect()}
    x = math.pi / 64
    for name, part in rows.groupby("g"):
        p = part[["latitude", "longitude"]].to_numpy(float)
        pairs = [np.hypot(*(p[i] - p[j])) for i in range(len(p)) for j in range(i)]
        want = np.mean(pairs) if pairs else 0.0
        assert want * x / math.tan(x) - 1e-9 <= got[name] <= want * x / math.sin(x) + 1e-9


def test_grid_clusters_are_dense_and_do_not_collide(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 1.0, 1.001), (3, 1.01, 11.5), (4, 1.02, 1.0)], "id bigint, latitude double, longitude double")
    got = {r.id: (r.geographic_cluster, r.cluster_size) for r in sp.grid_clusters(rows, 0.01).collect()}
    assert got[1] == got[2] and got[1][1] == 2
    assert sorted({c for c, _ in got.values()}) == [0, 1, 2]


@pytest.mark.parametrize("kind", ["even", "clustered", "spot"])
def test_few_queries_meet_few_leaves_however_dense_the_reference(spark, monkeypatch, kind):
    """Leaf pairs per asked point stay as they are when the reference grows fourfold."""
    gen = np.random.default_rng(3)
    asked = assets(np.linspace(-9, 9, 16), np.linspace(21, 39, 16)[::-1].copy())
    met = []
    keep = sp._leaf_pairs

    def watched(*args):
        pairs = keep(*args)
        met.append(pairs.groupBy("q").count().agg({"count": "max"}).first()[0])
        return pairs

    monkeypatch.setattr(sp, "_leaf_pairs", watched)
    for n in (2000, 8000):
        if kind == "even":
            lat, lon = gen.uniform(-10, 10, n), gen.uniform(20, 40, n)
        else:
            lat, lon = gen.normal(0, 0.5, n), gen.normal(30, 0.5, n)
        if kind == "spot":
            lat[: n // 3], lon[: n // 3] = 9.0, 21.0
        reference = assets(lat, lon)
        assert found(spark, asked, 10, reference) == brute(asked, 10, reference)
    assert met[1] <= max(40, 1.5 * met[0])


def test_pair_sums_of_crowded_and_tied_values(spark):
    """Clumps far apart, ties and weights: buckets of equal width would hold nearly everything."""
    import random

    rng = random.Random(9)
    groups = {
        "spread": [(rng.uniform(-5, 5), 1) for _ in range(900)],
        "clump": [(1e6, 1), (-1e6, 2)] + [(rng.gauss(0, 1e-3), rng.randint(1, 3)) for _ in range(2500)],
        "tied": [(float(rng.randint(0, 3)), rng.randint(1, 5)) for _ in range(300)],
        "one": [(2.5, 7)],
        "lone": [(1.0, 1)],
    }
    rows = [(k, v, w) for k, values in groups.items() for v, w in values]
    got = {r.g: r.pair_sum for r in sp.pair_sums(spark.createDataFrame(rows, "g string, v0 double, times int").repartition(3), ["g"], "v0", "times").collect()}
    for k, values in groups.items():
        want, seen, total = 0.0, 0, 0.0
        for v, w in sorted(values):
            want += w * (v * seen - total)
            seen, total = seen + w, total + w * v
        assert math.isclose(got[k], want, rel_tol=1e-9, abs_tol=1e-9), k


def test_density_per_group_equals_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.uniform(-1, 1) if i % 5 else 0.5, rng.uniform(30, 31) if i % 5 else 30.5, rng.choice("ab")) for i in range(200)]
    rows += [(900, 1.0, 30.0, "lone"), (901, 1.0, 30.0, None), (902, 2.0, 30.0, "twin"), (903, 2.0, 30.0, "twin")]
    got = {r.id: (r.cluster_size, r.cluster_density) for r in sp.cluster_density(spark.createDataFrame(rows, "id long, latitude double, longitude double, g string"), "g").collect()}
    assert 901 not in got and got[900] == (1, 0.0) and got[902] == (2, 10.0)
    for g in "ab":
        own = [r for r in rows if r[3] == g]
        pairs = [math.dist(a[1:3], b[1:3]) for n, a in enumerate(own) for b in own[:n]]
        want = 1 / (sum(pairs) / len(pairs) + 0.1)
        assert all(got[r[0]][0] == len(own) and math.isclose(got[r[0]][1], want, rel_tol=1e-3) for r in own)


def test_ids_of_one_spot_stay_one_row_until_spots_are_ranked(spark):
    """Towns of many ids per spot: a leaf counts ids, spots beyond enough of them go before ids are listed, ties go by id across spots."""
    i = np.arange(400)
    towns = assets(1.0 + (i * 37) % 400 % 8, 30.0 + (i * 37) % 400 % 5)
    points, _, n = sp._leaves(sp._spots(spark.createDataFrame(towns), 11))
    assert n == 40 and sum(r["size"] for r in sp._boxes(points).collect()) == 400
    assert found(spark, towns, 25) == sorted(brute(towns, 25))


def test_tasks_grow_in_number_with_the_points(spark):
    """What a task sorts is bounded by points, not by the session's shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(10).withColumnRenamed("id", "q")
    assert sp._spread(df, "q", 0).rdd.getNumPartitions() == 1
    assert sp._spread(df, "q", parts * sp.MOST_POINTS_PER_TASK * 3).rdd.getNumPartitions() == parts * 3
