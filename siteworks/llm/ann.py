"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the vectors along a random direction, level by level; the directions
are drawn from a seed, and where each node splits is the median of a bounded sample.
All rows go down all trees by those splits. A query searches the whole forest through one
priority queue: the node, of any tree, whose worst split so far lies nearest comes
next, until a number of leaves is reached. In each leaf that a query reaches, all
rows are compared exactly; the best few of each task are merged.

*Reach.* How many leaves a query reads is measured, at every size of table: queries taken from the sample search the forest, and the
reach is the one at which they find ``recall`` of their nearest sampled rows. Neighbours in the whole table
are nearer than in the sample, so this asks for no less than they need.

Leaves have ``leaf_rows`` rows or fewer: a tree gets deeper as the table grows; a small table is one leaf. Below the sample's
reach a level splits at the median of the whole sample along its direction. Rows with
the same vector can't be told apart by any split, so only as many of them as an answer
can hold are kept, those with the smallest ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.llm.common import store_counted
from siteworks.llm.embedding_dedup import _unit

NEIGHBOURS = 5
TREES = 4
LEAF_ROWS = 1024
#: Share of the sample's nearest rows that the reach is to find, and queries that it is measured with.
RECALL = 0.97
MEASURED = 256
#: Vectors that the splits are fitted on, at most about.
SAMPLE_ROWS = 20_000
#: A node with fewer sampled vectors does not have a median of its own.
LEAST_SAMPLE = 8


class Forest:
    """Directions and splits of all trees; small whatever the table."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.directions = rng.standard_normal((trees, depth, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits: list[list[np.ndarray]] = []
        for t in range(trees):
            spread = sample @ self.directions[t].T
            node = np.zeros(len(sample), dtype=np.int64)
            levels = []
            for level in range(depth):
                middle = float(np.median(spread[:, level])) if len(sample) else 0.0
                size = min(1 << level, max(1, len(sample) // LEAST_SAMPLE))
                split = np.full(size, middle)
                if size == 1 << level:
                    order = np.argsort(node, kind="stable")
                    bounds = np.searchsorted(node[order], np.arange(size + 1))
                    for k in range(size):
                        mine = spread[order[bounds[k] : bounds[k + 1]], level]
                        if len(mine) >= LEAST_SAMPLE:
                            split[k] = np.median(mine)
                else:
                    split = np.full(1, middle)
                levels.append(split)
                node = 2 * node + (spread[:, level] > (split[node] if len(split) > 1 else split[0]))
            self.splits.append(levels)

    def split(self, tree: int, level: int, node: int) -> float:
        split = self.splits[tree][level]
        return split[node] if len(split) > 1 else split[0]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.zeros((len(unit), self.trees), dtype=np.int64)
        for t in range(self.trees):
            spread = unit @ self.directions[t].T
            for level in range(self.depth):
                split = self.splits[t][level]
                out[:, t] = 2 * out[:, t] + (spread[:, level] > (split[out[:, t]] if len(split) > 1 else split[0]))
        return out

    def search(self, unit: np.ndarray) -> Iterator[tuple[int, int]]:
        """All leaves (tree, leaf) in the order of the shared queue."""
        spread = self.directions @ unit
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        while queue:
            worst, t, level, node = heapq.heappop(queue)
            if level == self.depth:
                yield t, node
                continue
            beyond = spread[t, level] - self.split(t, level, node)
            side = beyond > 0
            heapq.heappush(queue, (worst, t, level + 1, 2 * node + side))
            heapq.heappush(queue, (max(worst, abs(beyond)), t, level + 1, 2 * node + (not side)))

    def measured_reach(self, sample: np.ndarray, neighbours: int, recall: float) -> int:
        """Leaves to read so that rows of the sample find ``recall`` of their ``neighbours`` nearest others in it."""
        if not self.depth or len(sample) < 2:
            return 1
        leaves, ranks = self.leaves(sample), []
        for q in range(0, len(sample), -(-len(sample) // MEASURED)):
            near = sample @ sample[q]
            near[q] = -np.inf
            wanted = set(np.argpartition(-near, min(neighbours, len(near) - 1))[:neighbours].tolist()) - {q}
            for rank, (t, leaf) in enumerate(self.search(sample[q]), 1):
                held = {k for k in wanted if leaves[k, t] == leaf}
                ranks += [rank] * len(held)
                wanted -= held
                if not wanted:
                    break
        return int(np.quantile(ranks, recall, method="higher"))


def _route(forest: Forest, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            ok, rows = _unit(vectors)
            ok = [k for k, r in zip(ok, rows, strict=True) if len(r) == forest.directions.shape[2]]
            if not len(ok):
                continue
            unit = np.array([r for r in rows if len(r) == forest.directions.shape[2]])
            queries, candidates = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            leaves = forest.leaves(unit)
            index, place, asks = [], [], []
            for n, k in enumerate(ok):
                if candidates[k]:
                    for t in range(forest.trees):
                        index.append(k)
                        place.append((t, leaves[n, t]))
                        asks.append(False)
                if queries[k]:
                    for where in islice(forest.search(unit[n]), reach):
                        index.append(k)
                        place.append(where)
                        asks.append(True)
            at = pa.array(index, pa.int64())
            for start in range(0, len(index), 50_000):
                part = at.slice(start, 50_000)
                where = place[start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w[0] for w in where], pa.int32()),
                        pa.array([int(w[1]) for w in where], pa.int64()),
                        pa.array(asks[start : start + 50_000], pa.bool_()),
                        batch.column(0).take(part),
                        batch.column(1).take(part),
                    ],
                    names=["tree", "leaf", "asks", "vec_id", "vector"],
                )

    return run


def cosines(query: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosine of a vector with every row, each in the same order of operations."""
    return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * sizes)


def _nearest(neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}

        def trim(query: int) -> None:
            held = best[query]
            best[query] = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:neighbours])

        def flush() -> pa.RecordBatch:
            out = [(q, v, s) for q, held in best.items() for v, s in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:neighbours]]
            best.clear()
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        key = None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:  # sorted by leaf, candidates before queries
            trees, leaves, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vec = batch.column(3).to_numpy()
            width = len(batch.column(4)[0]) if batch.num_rows else 1
            data = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, width)
            change = np.flatnonzero((np.diff(trees) != 0) | (np.diff(leaves) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for at, end in zip([0, *change], [*change, batch.num_rows], strict=True):
                if at == end:
                    continue
                if (trees[at], leaves[at]) != key:
                    key, ids, rows, ready = (trees[at], leaves[at]), [], [], None
                if not asks[at]:
                    ids.append(vec[at:end])
                    rows.append(data[at:end])
                    continue
                if not ids:
                    continue
                if ready is None:
                    held = np.concatenate(rows)
                    ready = np.concatenate(ids), held, np.sqrt((held * held).sum(axis=1))
                names, held, sizes = ready
                for n in range(at, end):
                    score = cosines(data[n], held, sizes)
                    score[names == vec[n]] = -np.inf
                    least = np.partition(score, -neighbours)[-neighbours] if len(score) > neighbours else -np.inf
                    query = int(vec[n])
                    mine = best.setdefault(query, {})
                    for k in np.flatnonzero((score >= least) & (score > -np.inf)):
                        mine[int(names[k])] = float(score[k])
                    if len(mine) > 4 * neighbours:
                        trim(query)
            if len(best) > 50_000:
                yield flush()
        yield flush()

    return run


def search_vectors(
    vectors: DataFrame, asked: Column, neighbours: int = NEIGHBOURS, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for those of ``vectors`` (vec_id, embedding) that ``asked`` selects.

    Nearness is the cosine of the given vectors in double precision; ties go to the smaller id, and a row is
    no candidate of its own. Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part, nor do vectors of another width than most. Rows that share an id are one
    if their vectors are equal; otherwise the nearer of them counts. Other columns are not read. No rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite).distinct()
    # Spark keeps the first few of a group before it shuffles, so a vector that most rows share is no burden.
    alike = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= neighbours + 1)
    kept = first.select("vec_id", "vector", F.lit(False).alias("asks"), F.lit(True).alias("stays"))
    both = rows.where("asks").select("vec_id", "vector", "asks", F.lit(False).alias("stays")).union(kept)
    stored, seen = store_counted(both, "vectors", rows=F.count_if(F.col("stays")), width=F.mode(F.size("vector")))
    depth = max(0, math.ceil(math.log2(max(1, seen["rows"]) / leaf_rows)))

    part = min(1.0, SAMPLE_ROWS / max(1, seen["rows"]))
    chosen = stored.where("stays").where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 20)) < math.ceil(part * (1 << 20)))
    _, sample = _unit([r["vector"] for r in chosen.select("vector").collect()])
    width = seen["width"] or 1
    sample = np.array([r for r in sample if len(r) == width]).reshape(-1, width)
    forest = Forest(sample, depth, trees)
    reach = forest.measured_reach(sample, neighbours, recall)
    routed = stored.mapInArrow(_route(forest, reach), "tree int, leaf long, asks boolean, vec_id long, vector array<double>")
    grouped = routed.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "asks")
    found = grouped.mapInArrow(_nearest(neighbours), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")
