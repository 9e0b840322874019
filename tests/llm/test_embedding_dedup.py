"""Cross-polytope links against all pairs."""

import numpy as np
import pytest

from siteworks.llm.embedding_dedup import buckets, hadamard, link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, own string"


def brute(rows):
    ids = [r[0] for r in rows]
    ok = [r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if g else None for r, g in zip(rows, ok, strict=True)]
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98:
                links[a].append(b)
                links[b].append(a)
    root = [None] * len(rows)
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        root[a] = min(ids[b] for b in seen)
    return sorted((i, len(n), r, i == r) for i, n, r in zip(ids, links, root, strict=True))


def vectors(seed, width=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label, size in ((1, 60), (2, 1), (3, 150), (None, 3)):
        base = rng.standard_normal(width)
        for k in range(size):
            rows.append((1000 - i, (base + rng.standard_normal(width) * rng.choice([0.02, 0.1, 0.16])).astype(np.float32).tolist(), label, "x"))
            i += 1
            if k % 7 == 0:
                rows.append((1000 - i, rows[-1][1], label, "x"))
                i += 1
            if k % 5 == 0:
                rows.append((1000 - i, rng.standard_normal(width).astype(np.float32).tolist(), label, "x"))
                i += 1
    odd = [None, [], [0.0] * width, [None] * width, [float("nan")] * width, [float("inf")] * width, [1.0, 2.0], [1.0, 2.0], [1e-30] * width, [1e30] * width]
    return rows + [(2000 + k, v, 1, "x") for k, v in enumerate(odd)]


def test_equals_all_pairs(spark):
    rows = vectors(1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for options in ({}, {"block": 16}):
        got = sorted(tuple(r) for r in link_vectors(frame, tables=10, **options).collect())
        assert got == brute(rows)


def planted(seed, width=64):
    """Given-like vectors without links, and around some of them copies whose cosines lie on both sides of 0.98."""
    rng = np.random.default_rng(seed)
    rows = [(rng.standard_normal(width), int(rng.integers(0, 3))) for _ in range(1500)]
    for k in range(150):
        base, label = rows[10 * k]
        for _ in range(rng.integers(1, 6)):
            rows.append((base + rng.standard_normal(width) * np.linalg.norm(base) / np.sqrt(width) * rng.choice([0.05, 0.12, 0.18, 0.21, 0.3]), label if rng.random() < 0.9 else 5))
    return [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("seed", [3, 4])
def test_recall_of_planted_links(spark, seed):
    rows = planted(seed)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in link_vectors(frame).collect()}
    found = want = same = 0
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    for k, r in enumerate(rows):
        want += near[k].sum() - 1
        found += got[r[0]].n_links
        same += got[r[0]].n_links == near[k].sum() - 1
    assert want > 300 and found <= want and found >= 0.995 * want and same >= 0.998 * len(rows)


def test_transform_and_probes():
    x = np.random.default_rng(2).standard_normal((5, 8))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(hadamard(x), x @ h)
    codes = buckets(x, 3, 2)
    assert codes.shape == (5, 3, 3) and (codes[:, :, :1] != codes[:, :, 1:]).all()


def test_odd_tables(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, ""), (None, None, 1, "")]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("3", 2, 3, True), ("3", 2, 3, True), ("None", 0, None, True), ("None", 2, 3, False)]
