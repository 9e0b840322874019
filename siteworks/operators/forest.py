"""Forests on a table that is small once its features are bytes: trees are dealt to tasks, each finishes its own.

MLlib grows a forest level by level over all partitions: a job or more for each level, and dense statistics of every node that
each partition writes, moves and adds up. Deep trees have some thousand nodes of a few rows each, so nearly all of that is
about empty bins. Here each feature is a byte (one of 256 quantile bins of all rows), the table is broadcast if that makes it
small, and Spark deals the trees to tasks; only votes are shuffled. The forest is MLlib's: Poisson bootstrap, a new subset of
features for each node, Gini gain over at most 32 bins of the fit's own rows, leaves of one answer merged, class shares summed.
Tables that are not small stay with MLlib.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteworks.operators.joins import BROADCAST_BYTES

#: Bins of a stored feature, and of a feature within one fit (MLlib's ``maxBins``).
CODES, BINS = 256, 32
#: Rows of all trees that grow together: small samples share numpy's calls, large ones have a tree at a time.
ROWS_AT_ONCE = 200_000
#: Nodes whose histograms are made together, and rows that go down a tree together: what fits a core's cache.
NODES_AT_ONCE, SCORED_AT_ONCE = 256, 16_384


class Grown(NamedTuple):
    """Trees in one list of nodes: a row goes to ``child`` if its code is at most ``cut``, else to ``child + 1``; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    shares: np.ndarray


def fits_here(estimator) -> bool:
    """Whether a forest has the settings that this module grows."""
    if not isinstance(estimator, RandomForestClassifier) or estimator.isDefined("weightCol"):
        return False
    of = estimator.getOrDefault
    plain = {"impurity": "gini", "maxBins": BINS, "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "subsamplingRate": 1.0}
    return all(of(name) == value for name, value in plain.items()) and of("featureSubsetStrategy") in ("auto", "sqrt")


def bin_edges(rows: DataFrame, features: int) -> list[list[float]]:
    """For each feature of the vector, up to 255 values that end a bin: all distinct ones if they are few, else quantiles; from all rows."""
    x = rows.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    shares = [i / CODES for i in range(1, CODES)]
    got = {r.i: r for r in x.groupBy("i").agg(F.approx_count_distinct("x", 0.02).alias("n"), F.percentile_approx("x", shares, 10_000).alias("q")).collect()}
    few = [i for i, r in got.items() if r.n <= CODES * 5 // 4]
    known = {r.i: sorted(r.v) for r in x.where(F.col("i").isin(few)).groupBy("i").agg(F.collect_set("x").alias("v")).collect()} if few else {}
    return [[] if i not in got else known[i][:-1] if len(known.get(i, [None] * CODES * 2)) <= CODES else sorted(set(got[i].q)) for i in range(features)]


def packed(rows: DataFrame, features: int, edges: Sequence[Sequence[float]]) -> DataFrame:
    """``part, n, codes, labels``: for each partition the bytes of its features, one after the other, and of its labels."""
    cuts = [np.array(e) for e in edges]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, labels = None, [np.zeros((features, 0), np.uint8)], [np.zeros(0, np.uint8)]
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
                codes.append(np.stack([np.searchsorted(cuts[i], x[:, i]) for i in range(features)]).astype(np.uint8))
                labels.append(batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8))
        if part is not None:
            c, y = np.concatenate(codes, axis=1), np.concatenate(labels)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(y)]), pa.array([c.tobytes()]), pa.array([y.tobytes()])], ["part", "n", "codes", "labels"])

    given = rows.select(F.spark_partition_id().cast("bigint").alias("part"), vector_to_array("features").alias("x"), "label_index")
    return given.mapInArrow(pack, "part bigint, n bigint, codes binary, labels binary")


class ByteTable:
    """A stored table with ``features`` and ``label_index``, broadcast as bytes; partitions keep their places."""

    def __init__(self, rows: DataFrame, features: int, classes: int):
        self.rows, self.classes = rows, classes
        got = sorted(packed(rows, features, bin_edges(rows, features)).collect(), key=lambda r: r.part)
        codes = [np.frombuffer(r.codes, np.uint8).reshape(features, r.n) for r in got]
        labels = [np.frombuffer(r.labels, np.uint8) for r in got]
        self.starts = {r.part: start for r, start in zip(got, np.cumsum([0, *[r.n for r in got]]).tolist())}
        self.n = sum(r.n for r in got)
        self.labels = np.concatenate([np.zeros(0, np.uint8), *labels])
        self.codes = np.concatenate([np.zeros((features, 0), np.uint8), *codes], axis=1)
        self.shared = rows.sparkSession.sparkContext.broadcast((self.codes, self.labels))

    def where(self, conditions: Sequence[Column]) -> list[np.ndarray]:
        """For each condition, whether a row has it, in the table's order; one job."""
        held = [F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions)]

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, bits = None, []
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(0)[0].as_py()
                    bits.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]))
            if part is not None:
                bits = np.concatenate(bits, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([bits.shape[1]]), pa.array([np.packbits(bits, axis=1).tobytes()])], ["part", "n", "bits"])

        out = np.zeros((len(held), self.n), bool)
        for r in self.rows.select(F.spark_partition_id().cast("bigint").alias("part"), *held).mapInArrow(mark, "part bigint, n bigint, bits binary").collect():
            bits = np.frombuffer(r.bits, np.uint8).reshape(len(held), -1)
            out[:, self.starts[r.part] : self.starts[r.part] + r.n] = np.unpackbits(bits, axis=1, count=r.n)
        return list(out)


def byte_table(rows: DataFrame, features: int, classes: int) -> ByteTable | None:
    """The table as bytes, or nothing if they are too many to be broadcast."""
    return ByteTable(rows, features, classes) if rows.count() * (features + 1) <= BROADCAST_BYTES else None


def own_bins(codes: np.ndarray) -> np.ndarray:
    """For each feature the bin of each code: all codes that the given rows have, if they are few, else quantiles of these rows."""
    out = np.zeros((len(codes), CODES), np.uint8)
    for i, c in enumerate(codes):
        n = np.bincount(c, minlength=CODES)
        present = np.flatnonzero(n)
        if len(present) <= BINS:
            out[i] = np.minimum(np.searchsorted(present, np.arange(CODES)), len(present) - 1)
        else:
            # The bin in which a code's middle row lies, so that a frequent code does not take the codes below it along.
            middle = np.cumsum(n) - (n + 1) / 2
            out[i] = np.clip(middle * BINS // n.sum(), 0, BINS - 1)
    return out


def _best_cuts(table: np.ndarray, labels: np.ndarray, rows: np.ndarray, weights: np.ndarray, counts: np.ndarray, features: np.ndarray, totals: np.ndarray):
    """For each node (its rows lie together, ``counts`` of them) the best feature of those it may use, its cut, and whether that gains anything."""
    nodes, classes = totals.shape
    width, each = nodes * BINS, np.arange(nodes)
    n = totals.sum(axis=1)
    best, feature, cut = (totals**2).sum(axis=1) / n * (1 + 1e-12) + 1e-12, np.zeros(nodes, np.int64), np.full(nodes, BINS, np.int64)
    place = np.repeat(each * BINS, counts) + labels * width
    flat, length = table.reshape(-1), table.shape[1]
    for tried in features.T:
        bins = flat.take(np.repeat(tried * length, counts) + rows)
        sums = np.bincount(place + bins, weights=weights, minlength=classes * width).reshape(classes, nodes, BINS)
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        right = totals.T[:, :, None] - left
        left_n = left.sum(axis=0)
        right_n = n[:, None] - left_n
        score = np.einsum("cnb,cnb->nb", left, left) / np.maximum(left_n, 1) + np.einsum("cnb,cnb->nb", right, right) / np.maximum(right_n, 1)
        score[(left_n == 0) | (right_n == 0)] = -1
        top = score.argmax(axis=1)
        value = score[each, top]
        better = value > best
        best, feature, cut = np.where(better, value, best), np.where(better, tried, feature), np.where(better, top, cut)
    return feature, cut, cut < BINS


def grow(table: np.ndarray, labels: np.ndarray, classes: int, trees: int, depth: int, bootstrap: bool, rng: np.random.Generator) -> Grown:
    """Trees of all given rows (bins by feature, labels), level by level; the trees' nodes of a level are one list.

    Rows of an open node lie together. After a level all rows that go left come first, then all that go right, each in their order;
    ``ids`` are the nodes' numbers in that order.
    """
    features, length = table.shape
    some = max(1, int(np.ceil(np.sqrt(features))))
    drawn = rng.poisson(1.0, (trees, length)) if bootstrap else np.ones((trees, length), np.int64)
    tree, rows = np.nonzero(drawn)
    weights, labels = drawn[tree, rows].astype(np.float64), labels.astype(np.int64)[rows]
    counts, ids, first, level = np.bincount(tree, minlength=trees), np.arange(trees), 0, 0
    levels: list[tuple[np.ndarray, ...]] = []
    splits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        nodes = len(ids)
        totals = np.bincount(np.repeat(np.arange(nodes) * classes, counts) + labels, weights=weights, minlength=nodes * classes).reshape(nodes, classes)
        n = totals.sum(axis=1)
        feature, cut, child = np.zeros(nodes, np.int64), np.full(nodes, BINS, np.int64), ids.copy()
        open_ = (totals.max(axis=1) < n) if level < depth else np.zeros(nodes, bool)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for a in range(0, nodes, NODES_AT_ONCE):
            here = a + np.flatnonzero(open_[a : a + NODES_AT_ONCE])
            if not len(here):
                continue
            lo, hi = ends[a], ends[min(a + NODES_AT_ONCE, nodes)]
            parts = [labels[lo:hi], rows[lo:hi], weights[lo:hi]]
            if len(here) < min(NODES_AT_ONCE, nodes - a):
                keep = np.repeat(open_[a : a + NODES_AT_ONCE], counts[a : a + NODES_AT_ONCE])
                parts = [x[keep] for x in parts]
            tried = rng.random((len(here), features)).argpartition(some - 1, axis=1)[:, :some] if some < features else np.tile(np.arange(features), (len(here), 1))
            feature[here], cut[here], open_[here] = _best_cuts(table, *parts, counts[here], tried, totals[here])
        at = np.flatnonzero(open_)
        child[at] = first + nodes + 2 * np.arange(len(at))
        order = np.argsort(ids)
        levels.append(tuple(x[order] for x in (feature, cut, child, totals / np.maximum(n, 1)[:, None])))
        splits.append((ids[at], child[at]))
        if len(at) < nodes:
            keep = np.repeat(open_, counts)
            rows, weights, labels = rows[keep], weights[keep], labels[keep]
        counts = counts[at]
        right = table.reshape(-1).take(np.repeat(feature[at] * length, counts) + rows) > np.repeat(cut[at], counts)
        n_right = np.bincount(np.repeat(np.arange(len(at)), counts)[right], minlength=len(at))
        order = np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)])
        rows, weights, labels = (x.take(order) for x in (rows, weights, labels))
        counts, ids = np.concatenate([counts - n_right, n_right]), np.concatenate([child[at], child[at] + 1])
        first, level = first + nodes, level + 1
    feature, cut, child, shares = (np.concatenate(x) for x in zip(*levels))
    # A node whose two leaves give the same answer is a leaf.
    answer, leaf = shares.argmax(axis=1), child == np.arange(len(child))
    for above, below in reversed(splits):
        same = leaf[below] & leaf[below + 1] & (answer[below] == answer[below + 1])
        child[above[same]], cut[above[same]], leaf[above[same]] = above[same], BINS, True
    return Grown(np.arange(trees), feature, cut, child, shares)


def add_votes(grown: Grown, table: np.ndarray, rows: np.ndarray, votes: np.ndarray) -> None:
    """Add the class shares of each row's leaf in each tree to the votes of the rows."""
    flat, length = table.reshape(-1), table.shape[1]
    ahead = grown.feature * length
    leaf = grown.child == np.arange(len(grown.child))
    for a in range(0, len(rows), SCORED_AT_ONCE):
        here = rows[a : a + SCORED_AT_ONCE]
        for root in grown.roots:
            last = np.full(len(here), root)
            place, row, node = np.arange(len(here)), here, last
            while len(node):
                # A leaf is its own child, so rows that are done may go round until they are worth sorting out.
                ends = leaf.take(node)
                done = np.count_nonzero(ends)
                if done * 4 > len(node):
                    last[place[ends]] = node[ends]
                    keep = np.flatnonzero(~ends)
                    place, row, node = place.take(keep), row.take(keep), node.take(keep)
                node = grown.child.take(node) + (flat.take(ahead.take(node) + row) > grown.cut.take(node))
            votes[a : a + SCORED_AT_ONCE] += grown.shares.take(last, axis=0)


class TableForest:
    """A forest of some rows of a byte table. Its trees grow in the tasks that count their votes, the same ones each time."""

    def __init__(self, table: ByteTable, seen: Column, chosen: Sequence[int], estimator: RandomForestClassifier):
        of = estimator.getOrDefault
        self.table, self.seen, self.chosen = table, seen, list(chosen)
        self.trees, self.depth, self.seed, self.bootstrap = of("numTrees"), of("maxDepth"), of("seed"), of("bootstrap")

    def votes(self, seen: np.ndarray, asked: np.ndarray) -> DataFrame:
        """``first, votes``: summed class shares of the asked rows, from place ``first`` on, of each group of trees."""
        spark = self.table.rows.sparkSession
        fit = (self.trees, self.depth, self.bootstrap, self.seed & (2**64 - 1), self.chosen, self.table.classes)
        together = max(1, ROWS_AT_ONCE // max(1, int(seen.sum())))
        groups = -(-self.trees // together)
        marks = spark.sparkContext.broadcast(np.packbits(np.stack([seen, asked]), axis=1))
        tasks = spark.range(0, groups, 1, min(groups, max(1, spark.sparkContext.defaultParallelism)))
        return tasks.mapInArrow(_votes(self.table.shared, marks, fit, together), "block bigint, first bigint, votes binary")

    def scores(self, parts: Mapping[str, Column]) -> dict[str, tuple[int, float | None, float | None]]:
        """For each part: rows, share of right answers, share of the most frequent class."""
        seen, *held = self.table.where([self.seen, *parts.values()])
        if not seen.any():
            raise ValueError("a forest needs rows to grow on")
        asked = np.logical_or.reduce(held)
        right = self._right(seen, asked)
        out = {}
        for name, part in zip(parts, held):
            n, labels = int(part.sum()), np.bincount(self.table.labels[part], minlength=self.table.classes)
            out[name] = (n, float(right[part].sum() / n) if n else None, float(labels.max() / n) if n else None)
        return out

    def _right(self, seen: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whether the forest's answer is right, for each asked row."""
        votes = self.votes(seen, asked)
        sums = votes.groupBy("first").applyInArrow(_answers(self.table.classes), "first bigint, answers binary")
        answers = np.full(self.table.n, 255, np.uint8)
        places = np.flatnonzero(asked)
        for r in sums.collect():
            got = np.frombuffer(r.answers, np.uint8)
            answers[places[r.first : r.first + len(got)]] = got
        return answers == self.table.labels


def _votes(shared, marks, fit, together: int) -> Callable:
    trees, depth, bootstrap, seed, chosen, classes = fit

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [g for batch in batches for g in batch.column(0).to_pylist()]
        if not groups:
            return
        codes, labels = shared.value
        seen, asked = (np.unpackbits(m, count=len(labels)).astype(bool) for m in marks.value)
        mine, rows = np.flatnonzero(seen), np.flatnonzero(asked)
        given = codes[chosen]
        bins = own_bins(given[:, mine])
        table = np.stack([b[c] for b, c in zip(bins, given)])
        train, answers = np.ascontiguousarray(table[:, mine]), labels[mine]
        sums = np.zeros((len(rows), classes))
        for g in groups:
            rng = np.random.default_rng([seed, g])
            add_votes(grow(train, answers, classes, min(together, trees - g * together), depth, bootstrap, rng), table, rows, sums)
        for a in range(0, len(rows), SCORED_AT_ONCE):
            some = sums[a : a + SCORED_AT_ONCE].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([groups[0]]), pa.array([a]), pa.array([some])], ["block", "first", "votes"])

    return votes


def _answers(classes: int) -> Callable:
    def answers(table: pa.Table) -> pa.Table:
        blocks = sorted(zip(table["block"].to_pylist(), table["votes"].to_pylist()))
        votes = sum(np.frombuffer(v, np.float32).astype(np.float64) for _, v in blocks).reshape(-1, classes)
        return pa.table({"first": [table["first"][0].as_py()], "answers": [votes.argmax(axis=1).astype(np.uint8).tobytes()]})

    return answers
