"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash
is the axis it then lies closest to, with its sign. ``parts`` such hashes name a bucket
of one of ``tables`` tables. A vector lives in one bucket of each table and also probes
the buckets with its second axis in place of the first, part by part. Whoever meets in
a bucket is compared exactly.

A pair that meets more than once counts only where it meets first, which both vectors'
bucket lists tell, so nothing but a count and one edge of a vector leaves a bucket.
Equal vectors are one node. Large buckets are cut into blocks that are compared pair
by pair in tasks of bounded size; their work, not their rows, is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.llm.common import components, store

THRESHOLD = 0.98
TABLES = 6
PARTS = 2
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int, parts: int, seed: int = 7) -> np.ndarray:
    """For every row and table: its own bucket, then one probe for each part."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    out = np.empty((n, tables, 1 + parts), dtype=np.int64)
    rng = np.random.default_rng(seed)
    for t in range(tables):
        first, second = [], []
        for _ in range(parts):
            turned = padded
            for signs in rng.choice([-1.0, 1.0], size=(3, width)):
                turned = hadamard(turned * signs)
            size = np.abs(turned)
            best = size.argmax(axis=1)
            size[np.arange(n), best] = -1
            after = size.argmax(axis=1)
            first.append(2 * best + (turned[np.arange(n), best] > 0))
            second.append(2 * after + (turned[np.arange(n), after] > 0))
        for probe in range(1 + parts):
            code = np.zeros(n, dtype=np.int64)
            for p in range(parts):
                code = code * 2 * width + (second[p] if probe == p + 1 else first[p])
            out[:, t, probe] = code
    return out


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be compared (not null or zero, all components finite), and those as unit rows of equal width."""
    ok, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or any(c is None for c in v):
            continue
        x = np.asarray(v, dtype=float)
        norm = np.sqrt((x * x).sum()) if len(x) else 0.0
        if len(x) and np.isfinite(x).all() and norm > 0:
            if not np.isfinite(norm) or norm < 1e-150:
                x = x / np.abs(x).max()
                norm = np.sqrt((x * x).sum())
            ok.append(i)
            rows.append(x / norm)
    return np.array(ok, dtype=int), rows


def _codes(tables: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            ok, rows = _unit(vectors)
            widths = np.array([len(r) for r in rows])
            for width in np.unique(widths):
                of = np.flatnonzero(widths == width)
                unit = np.array([rows[i] for i in of])
                codes = buckets(unit, tables, parts).reshape(len(of), -1)
                at = pa.array(ok[of])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(np.full(len(of), width), pa.int32()),
                        pa.array(unit.tolist(), pa.list_(pa.float64())),
                        pa.array(codes.tolist(), pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "label", "width", "unit", "codes"],
                )

    return run


def _links(threshold: float, tables: int, parts: int):
    """Rows sorted by bucket and block pair in; for every vector its links met here first, and one linked vector here."""
    probes = 1 + parts

    def group(key: tuple, rows: dict[str, np.ndarray]) -> tuple | None:
        table, i, j = key[0], key[-2], key[-1]
        unit, weight, home, side = rows["unit"], rows["weight"], rows["home"], rows["block"]
        m = len(home)
        if m < 2:
            return None
        near = unit @ unit.T >= threshold
        near[~home[:, None] & ~home[None, :]] = False
        np.fill_diagonal(near, False)
        if i != j:
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(near))
        if not len(a):
            return None
        root = np.arange(m)
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        codes = rows["codes"].reshape(m, tables, probes)
        first = np.ones(len(a), dtype=bool)
        for t in range(table + 1):
            meets_b = (codes[a, t, :1] == codes[b, t]).any(axis=1)  # b comes to a's own bucket
            meets_a = (codes[b, t, :1] == codes[a, t]).any(axis=1)
            if t < table:
                first &= ~(meets_a | meets_b)
            else:
                here = key[3]
                other = np.where(codes[a, t, 0] == here, np.where(meets_a, codes[b, t, 0], here), np.where(meets_b, codes[a, t, 0], here))
                first &= here <= other
        links = np.zeros(m, dtype=np.int64)
        np.add.at(links, a[first], weight[b[first]])
        np.add.at(links, b[first], weight[a[first]])
        return links, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        keys = ["t", "label", "width", "bucket", "i", "j"]

        def finish(table: pa.Table) -> pa.RecordBatch:
            out_id, out_links, out_to = [], [], []
            key = list(zip(*[table[k].to_pylist() for k in keys], strict=True))
            cut = [0, *[n for n in range(1, len(key)) if key[n] != key[n - 1]], len(key)]
            node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
            home, side = table["home"].to_numpy(zero_copy_only=False).astype(bool), table["block"].to_numpy()
            for at, end in zip(cut, cut[1:], strict=False):
                if end - at < 2:
                    continue
                part = table.slice(at, end - at)
                rows = {
                    "unit": part["unit"].combine_chunks().flatten().to_numpy().reshape(end - at, -1),
                    "codes": part["codes"].combine_chunks().flatten().to_numpy(),
                    "weight": weight[at:end], "home": home[at:end], "block": side[at:end],
                }
                made = group(key[at], rows)
                if made is not None:
                    links, root = made
                    told = (links > 0) | (root != np.arange(end - at))
                    out_id.append(node[at:end][told])
                    out_links.append(links[told])
                    out_to.append(node[at:end][root[told]])
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(join(x), pa.int64()) for x in (out_id, out_links, out_to)], names=["node", "links", "to"])

        last = None
        for batch in batches:  # a group may go on in the next batch: the last one is kept back
            if not batch.num_rows:
                continue
            ids = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            key = list(zip(*ids, strict=True))
            new = next((n for n in range(len(key) - 1, -1, -1) if key[n] != (key[n - 1] if n else last)), None)
            last = key[-1]
            if new is None:
                held.append(batch)
                continue
            held.append(batch.slice(0, new))
            done = pa.Table.from_batches(held)
            if done.num_rows:
                yield finish(done)
            held = [batch.slice(new)]
        if held:
            yield finish(pa.Table.from_batches(held))

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are linked when their labels are equal, their cosine is at least ``threshold`` and they meet in
    a bucket. A null label, and a vector that is null, empty, zero or holds null or non-finite
    components, links with nothing, as do vectors of different widths. Rows with equal vectors and labels
    link with one another whatever their ids; a null vec_id names no component. No rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("own", F.xxhash64("label", "embedding"))
    # Equal vectors: a node with a weight. Nodes are named by a hash of label and vector.
    nodes = rows.where("label is not null and embedding is not null").groupBy("own").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")
    )
    made = nodes.select("own", F.struct("weight", "least", F.xxhash64("label").alias("label")).alias("label"), "embedding").mapInArrow(
        _codes(tables, parts), "own long, label struct<weight:bigint,least:bigint,label:bigint>, width int, unit array<double>, codes array<long>"
    )
    made = store(made.select("own", "label.*", "width", "unit", "codes"), "vector-codes")

    per = 1 + parts
    placed = made.select("own", "label", "width", F.posexplode("codes").alias("k", "bucket"))
    placed = placed.select("own", "label", "width", F.floor(F.col("k") / per).cast("int").alias("t"), (F.col("k") % per == 0).alias("home"), "bucket")
    place = ["t", "label", "width", "bucket"]
    busy = placed.groupBy(*place).agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived")
    busy = busy.select(*place, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = placed.join(busy, place).withColumn("block", F.pmod(F.xxhash64("own", F.lit(3)), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("own", *place, "home", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    full = met.join(made.select("own", "weight", "unit", "codes"), "own").withColumnRenamed("own", "node")
    full = full.select(*place, "i", "j", "node", "weight", "home", "block", "unit", "codes")
    grouped = full.repartition(*place, "i", "j").sortWithinPartitions(*place, "i", "j")
    found = store(grouped.mapInArrow(_links(threshold, tables, parts), "node long, links long, to long"), "vector-links")

    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    roots = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")), "vector")
    known = made.select("own", "weight", "least")
    known = known.join(counts.withColumnRenamed("node", "own"), "own", "left").join(roots.withColumnRenamed("node", "own"), "own", "left")
    known = known.select("own", "least", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "own").alias("root"))
    known = store(known, "vector-nodes")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(named, "root").select("own", "n_links", "component_id")
    linked = F.when(F.col("label").isNotNull(), F.col("own"))
    out = rows.select("vec_id", linked.alias("own")).join(known, "own", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
