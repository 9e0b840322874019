"""Exact self-join of documents whose sets of word shingles are nearly equal.

*Several global orders instead of one.* All shingles are split by their hash into
``p`` cells; order ``c`` of ``p`` global orders puts the shingles of cell ``c`` first, and a
document's prefix under it is all it has in that cell. Two sets of together ``s``
shingles and Jaccard similarity ``t`` or more differ in at most
``d = s * (1 - t) / (1 + t)`` shingles, and each spoils one prefix at most. With
``p > d`` orders, linked documents share their whole prefix under ``p - d`` orders or
more, so none is missed; and a whole prefix of several shingles is shared by far
fewer others than one frequent shingle would be, whatever passage is common.

``p`` is taken for a class of sizes; a set close below the next class takes part there too.
A set may differ from those it links with in fewer shingles than ``p`` allows for, so of
its ``p`` prefixes only the first ones are written, two more than may be spoiled: filled
cells come before empty ones, as many sets have the same cell empty.

*Intersection.* Linked sets share two written prefixes or more, so a node that shares but one with any
others ends at once. A candidate pair is verified only if its nodes agree on all but ``d`` cells of a finer split
of the orders: the filters of all orders are intersected before a set is read.

*Copies.* Documents with equal sets are one node throughout. *Verification* counts
the common shingles of a candidate pair exactly. Nodes that share a prefix are first
verified against the smallest of them only, then against one of the largest group of linked
nodes among them. What stays in different groups is taken pair by pair, in blocks, where
the finer cells are compared before a pair is even written down. So a large group of near copies writes about a
multiple of its size, and every pair that could join two groups is still looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.llm.common import ByteHash, chunks, components, discard, free_name, grouped_rows, mix, row_key, slices, store, text_bytes

SHINGLE = 3
PERCENT = 90
#: A size class ends at 1 / similarity ** ``GROWTH`` times the end of the one before: about one set in ``GROWTH`` takes part in two classes.
GROWTH = 4
#: Prefixes that linked sets have in common at least.
SHARED = 2
#: Cells of the finer split for each shingle that linked sets may differ in.
FINER = 4
#: Prefixes with more open nodes than this are compared in blocks of ``BLOCK`` nodes instead of joined.
FEW = 8
BLOCK = 512
#: Bytes of cells in a block, about: nodes with many cells are compared in smaller blocks.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _set_of(index: list[int], parts: list[bytes], size: int, hasher: ByteHash) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data].view(np.int8)))  # a word begins after, ends after
    begin, end = edges[::2] + 1, edges[1::2] + 1
    first = np.cumsum([1, *[len(p) + 1 for p in parts]])
    owner = np.searchsorted(first, begin, side="right") - 1
    sums = hasher.sums(data)
    words = mix(hasher.spans(sums, begin, end) + (end - begin).astype(np.uint64))
    per = np.bincount(owner, minlength=len(parts))
    start = np.concatenate([[0], np.cumsum(per)[:-1]])
    full = np.flatnonzero(np.arange(len(words)) + size <= (start + per)[owner])
    shingle = np.zeros(len(full), dtype=np.uint64)
    for k in range(size):
        shingle = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + words[full + k])
    short = np.flatnonzero((per > 0) & (per < size))
    few = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        has = per[short] > k
        few = np.where(has, mix(few * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(start[short] + k, max(0, len(words) - 1))]), few)
    few = mix(few + per[short].astype(np.uint64))
    who, what = np.concatenate([owner[full], short]), np.concatenate([shingle, few])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return np.asarray(index)[who[new]], what[new]


def size_classes(percent: int) -> list[int]:
    """Largest set size of every class: the first holds sets that link with equal sets only (at 90 %, 9 of 10 is the first difference allowed)."""
    bounds = [next(n for n in range(1, 10_000) if 2 * (n + 1) * (100 - percent) // (100 + percent) >= 1)]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 2, int(bounds[-1] * (100 / percent) ** GROWTH)))
    return bounds


def cells_of(upper, percent: int):
    """Cells of a size class: some more than sets of it may differ in, so that most sets fill more than they may differ in."""
    differ = 2 * upper * (100 - percent) // (100 + percent)
    return differ + SHARED + differ // 16


def _prefixes(size: int, percent: int):
    bounds = np.array(size_classes(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(3, _LOWER)
        for batch in slices(batches):
            texts = text_bytes(batch.column(2))
            keys: list[list[int]] = [[] for _ in texts]
            nodes, counts = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
            for index, _, parts in chunks(texts):
                who, what = _set_of(index, parts, size, hasher)
                if not len(who):
                    continue
                begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                n = np.diff(np.append(begin, len(who)))
                spread = mix(what ^ np.uint64(0x5DEECE66D))
                nodes[who[begin]] = mix(np.add.reduceat(spread, begin) + n.astype(np.uint64))
                counts[who[begin]] = n
                level = np.searchsorted(bounds, n)
                for step in (0, 1):
                    at = level + step
                    upper = bounds[at]
                    cells = cells_of(upper, percent)
                    takes = (at > 0) & ((step == 0) | (100 * n > percent * bounds[level]))
                    rows = np.repeat(takes, n)
                    if not rows.any():
                        continue
                    # The sets that these link with here differ from them in fewer shingles than two of the class may.
                    needed = (n + np.minimum(100 * n // percent, upper)) * (100 - percent) // (100 + percent) + SHARED
                    cell = ((what >> np.uint64(32)) * np.repeat(cells, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                    new = np.append(True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1]))
                    new = np.flatnonzero(new)
                    doc = np.searchsorted(begin, new, side="right") - 1
                    filled = np.bincount(doc, minlength=len(n))
                    mark = (at[doc].astype(np.uint64) << np.uint64(40)) + cell[new].astype(np.uint64)
                    key = _with_level(mix(np.add.reduceat(spread, new) ^ mix(mark)), mark)
                    keep = rows[new] & (np.arange(len(new)) - (np.cumsum(filled) - filled)[doc] < needed[doc])
                    for d, k in zip(*_runs(who[new][keep], key[keep]), strict=True):
                        keys[d].extend(k)
                    # Empty cells come last in every document, so few need any of them.
                    for j in np.flatnonzero(takes & (needed > filled)):
                        mine = new[(new >= begin[j]) & (new < begin[j] + n[j])]
                        empty = np.setdiff1d(np.arange(cells[j]), cell[mine])[: needed[j] - filled[j]].astype(np.uint64)
                        mark = (np.uint64(at[j]) << np.uint64(40)) + empty
                        keys[who[begin[j]]].extend(_with_level(mix(mix(mark)), mark).view(np.int64).tolist())
            has = counts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(nodes.view(np.int64), mask=~has),
                    pa.array(counts),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "node", "n", "keys"],
            )

    return run


def _with_level(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The last bit of a key tells odd size classes from even ones: a set takes part in one of each."""
    return (key & ~np.uint64(1)) | (mark >> np.uint64(40) & np.uint64(1))


def _runs(who: np.ndarray, values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Values by owner; ``who`` is sorted."""
    if not len(who):
        return [], []
    cut = np.flatnonzero(who[1:] != who[:-1]) + 1
    return who[np.append(0, cut)].tolist(), [v.view(np.int64).tolist() for v in np.split(values, cut)]


def _shingles(size: int, percent: int):
    """The sets themselves, their size class, and for it and the next one a checksum of each cell of a finer split."""
    bounds = size_classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(3, _LOWER)
        for batch in slices(batches, 64):
            sets, levels, checks = [], [], []
            for text in text_bytes(batch.column(1)):
                what = _set_of([0], [text], size, hasher)[1]
                level = bisect_left(bounds, len(what))
                of_class = []
                for upper in bounds[level : level + 2]:
                    cells = FINER * (2 * upper * (100 - percent) // (100 + percent) + 1)
                    at = ((what & np.uint64(0xFFFFFFFF)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
                    # Sums modulo 256: equal cells have equal ones.
                    of_class.append(np.bincount(at, (mix(what) & np.uint64(255)).astype(np.float64), cells).astype(np.int64).astype(np.uint8).tobytes())
                sets.append(what.view(np.int64))
                levels.append(level)
                checks.append(of_class)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(levels, pa.int32()),
                    *[pa.array([c[k] for c in checks], pa.binary()) for k in (0, 1)],
                    pa.array(sets, pa.list_(pa.int64())),
                ],
                names=["node", "n", "level", "own", "above", "items"],
            )

    return run


def _few_differ(percent: int):
    """Pairs (a, b) whose finer cells differ in no more than linked sets could."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, left, right in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                cells = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in (left, right)]
                keep.append(np.count_nonzero(cells[0] != cells[1]) <= total * (100 - percent) // (100 + percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _alike(percent: int):
    """Pairs (a, b) of a block pair in different groups whose finer cells differ in no more than linked sets could."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "i", "j"]

        def pairs(part: pa.Table) -> pa.RecordBatch:
            node, n, root, block = (part[c].to_numpy() for c in ("node", "n", "root", "block"))
            # The cells as they lie in the Arrow buffer, without a copy for each node.
            cells = part["fine"].combine_chunks()
            width = len(cells[0].as_buffer())
            fine = np.frombuffer(cells.buffers()[2], dtype=np.uint8)[cells.offset * width : (cells.offset + len(node)) * width].reshape(len(node), width)
            step = max(1, BLOCK_BYTES // width)
            across = part["i"][0].as_py() != part["j"][0].as_py()
            left, right = [], []
            for r in range(len(node) - 1):
                rest = slice(r + 1, None)
                may = (root[rest] != root[r]) & (100 * np.minimum(n[rest], n[r]) >= percent * np.maximum(n[rest], n[r]))
                if across:
                    may &= block[rest] != block[r]
                of = np.flatnonzero(may) + r + 1
                if len(of):
                    differ = np.concatenate([np.count_nonzero(fine[of[at : at + step]] != fine[r], axis=1) for at in range(0, len(of), step)])
                    of = of[differ <= (n[of] + n[r]) * (100 - percent) // (100 + percent)]
                    left.append(np.minimum(node[of], node[r]))
                    right.append(np.maximum(node[of], node[r]))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(join(left), pa.int64()), pa.array(join(right), pa.int64())], names=["a", "b"])

        yield from map(pairs, grouped_rows(batches, keys))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets have at least ``percent`` of their union in common.

    The filters of all orders are intersected first: of the cells of a finer split, linked sets differ in as many as they
    differ in shingles at most. Sets that can link are of one size class or of neighbouring ones.
    """
    cells = ["node", "n", "level", "own", "above"]
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{side}") for c in cells]) for side in "ab")
    both = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
    apart = F.col("level_b") - F.col("level_a")
    left = F.when(apart == 1, F.col("above_a")).otherwise(F.col("own_a"))
    right = F.when(apart == -1, F.col("above_b")).otherwise(F.col("own_b"))
    both = both.where(F.abs(apart) <= 1).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("s"), left.alias("left"), right.alias("right"))
    alike = store(both.mapInArrow(_few_differ(percent), "a long, b long"), "alike")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
    both = alike.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("left", "right")).cast("bigint")
    counted = both.select("a", "b", common.alias("i"), (F.size("left") + F.size("right")).cast("bigint").alias("s"))
    linked = store(counted.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), label)
    discard(alike)
    return linked


def _open(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``near`` (key, node, n) with their groups, for prefixes that more than one group shares."""
    rows = store(near.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "grouped")
    split = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    split = store(split, "split-keys")
    open_ = store(rows.join(split, "key"), "open")
    discard(rows)
    discard(split)
    return open_


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (key, node, ...) whose key several nodes have, with the smallest of them."""
    ends = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    ends = store(ends, "shared-keys")  # a plain side: Spark can split what a hot key joins
    shared = store(keys.join(ends, "key").distinct(), "shared-prefixes")
    discard(ends)
    return shared


def _groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, row, node, n, root) for every row: equal roots are linked; without shingles, node and root are null."""
    keyed = docs.select("doc_id", row_key().alias("row"), "text")
    made = keyed.mapInArrow(_prefixes(shingle, percent), "doc_id long, row long, node long, n long, keys array<long>")
    made = store(made, "shingle-prefixes")
    rows = store(made.select("doc_id", "row", "node", "n"), "nodes")
    first = _shared(made.where("node is not null").select("node", F.explode("keys").alias("key")))
    discard(made)

    # Nodes that share a prefix under one order only are no candidates of any other.
    several = store(first.groupBy("node").agg(F.count("*").alias("orders")).where(F.col("orders") >= SHARED).select("node"), "candidates")
    both = store(first.select("key", "node").join(several, "node"), "candidate-prefixes")
    discard(first)
    discard(several)
    shared = _shared(both)
    discard(both)
    sizes = rows.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("row").alias("row"))
    sizes = store(sizes.join(shared.select("node").distinct(), "node", "left_semi"), "node-sizes")
    near = store(shared.join(sizes.select("node", "n"), "node"), "near")
    discard(shared)

    # Sets of the nodes that share prefixes with others, from one document each.
    texts = keyed.select("row", "text").dropDuplicates(["row"]).join(sizes.select("node", "row"), "row").select("node", "text")
    sets = store(texts.mapInArrow(_shingles(shingle, percent), "node long, n long, level int, own binary, above binary, items array<long>"), "shingle-sets")
    discard(sizes)

    # First against the smallest node of a prefix, then against one of its largest group.
    tried = store(near.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    links = _verified(tried, sets, percent, "links")
    roots = components(links, "near")
    open_ = _open(near.select("key", "node", "n"), roots)
    discard(near)
    discard(roots)
    group_sizes = store(open_.select("node", "root").distinct().groupBy("root").agg(F.count("*").alias("size")), "group-sizes")
    ranked = open_.join(group_sizes, "root").select("key", "node", "root", "size", F.col("node").bitwiseXOR(F.col("key")).alias("draw"))
    chosen = ranked.groupBy("key").agg(F.max(F.struct("size", "root", "draw")).alias("most"))
    chosen = store(chosen.select("key", F.col("most.root").alias("into"), F.col("most.draw").bitwiseXOR(F.col("key")).alias("one")), "chosen")
    second = open_.join(chosen, "key").where("root <> into").select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b"))
    second = store(second.distinct().join(tried, ["a", "b"], "left_anti"), "tried-next")
    links = store(links.union(_verified(second, sets, percent, "links-next")), "links-both")
    discard(group_sizes)
    discard(chosen)

    # What is still apart: few nodes of a prefix are joined, many compared in blocks.
    roots = components(links, "next")
    before = open_
    open_ = _open(before.select("key", "node", "n"), roots)
    discard(before)
    discard(roots)
    counted = store(open_.groupBy("key").agg(F.count("*").alias("open")), "open-counts")
    before = open_
    open_ = store(before.join(counted, "key"), "open-counted")
    discard(before)
    discard(counted)
    few = open_.where(F.col("open") <= FEW)
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "root")]) for side in "ab")
    alike = (F.col("root_a") < F.col("root_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    rest = a.join(b, "key").where(alike).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    fine = F.when(F.col("key").bitwiseAND(1) == F.col("level") % 2, F.col("own")).otherwise(F.col("above"))
    many = open_.where(F.col("open") > FEW).join(sets.select("node", "level", "own", "above"), "node").select(*open_.columns, fine.alias("fine"))
    # All nodes of a key have as many cells.
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / F.octet_length("fine"))))
    many = many.withColumn("blocks", F.ceil(F.col("open") / per_block).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", "node", "n", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "fine")
    blocks = many.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_alike(percent), "a long, b long")
    rest = store(rest.union(blocks).distinct().join(tried.union(second), ["a", "b"], "left_anti"), "tried-last")
    for done in (open_, tried, second):
        discard(done)
    roots = components(links.union(_verified(rest, sets, percent, "links-last")), "all")
    for done in (rest, sets):
        discard(done)
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach. Texts that are null, empty or
    white space have no shingles and link with nothing; fewer words than ``shingle`` are
    one shingle. Rows that share a doc_id are one document for its links; a row with a
    null doc_id links, but no component is named after it: alone, its component is null.
    Ties and repeated rows fall into one component. Texts of any length are read whole, and other columns
    are not read, whatever their names. No rows give no rows.
    """
    grouped = _groups(docs, shingle, percent)
    named = store(grouped.where("node is not null").groupBy("root").agg(F.min("doc_id").alias("first")), "group-names")
    out = grouped.join(named, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
    return out


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group of linked rows: one with the smallest doc_id, or without an id if none has one.

    Rows are told apart by id and text, so unlike texts that share an id both stay, and repeated
    rows are copies of each other. Rows without shingles link with nothing and all stay. Texts of any
    length are read whole; all columns of ``docs`` are returned as they are, whatever their names. No rows give no rows.
    """
    grouped = _groups(docs, shingle, percent).where("node is not null")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    key = free_name(docs, "kept_row")
    kept = store(first.select(F.col("first.row").alias(key)), "kept-rows")
    linked = docs.withColumn(key, row_key()).join(kept, key, "left_semi").dropDuplicates([key])
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return linked.select(docs.columns).unionByName(docs.where(blank))
