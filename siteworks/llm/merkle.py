"""A Merkle manifest of a dataset: one tree of digests per source, one tree over the sources' roots.

*Layout.* Nodes of a tree are stored in aligned subtrees ("blocks") of ``levels`` levels of
runs: a block holds the nodes above ``fan ** levels`` neighbouring leaves. Inside a block they stand in the
order of van Emde Boas: the tree is split at half its height into a top tree and the
trees below it, each stored whole and split again. ``address`` gives a node's place by arithmetic
alone, for building a block as for reading the siblings of a node; no index is kept.

*Recursion.* The roots of a forest's blocks are the leaves of the next forest, until
every group is one block: three rounds for 10^10 leaves. Each round moves a root per block.

*Scale.* Leaves get their place in the source by a range sort and one count per slice, so a
source with a third of all rows is spread like any other; a task holds one block at a time.
Proofs go down again: a block gets the siblings above it (about a kilobyte a level) and
adds those inside it for each of its leaves, so no leaf is moved a second time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.llm.common import crc32_sql, discard, store, store_counted

FAN = 16
#: Levels of runs in a block: 16^3 leaves, about 0.3 MB of digests.
LEVELS = 3
#: Bytes of a digest: 64 hex digits.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def subtree_size(height: int, fan: int = FAN) -> int:
    """Nodes of a full tree with ``height`` levels of nodes."""
    return (fan**height - 1) // (fan - 1)


def address(height: int, depth: int, index, fan: int = FAN):
    """Place of the ``index``-th node of a level, ``depth`` levels below the root, in a tree of ``height`` levels of nodes.

    ``index`` may be an array. The top half of the levels comes first, then each tree below it, whole.
    """
    at = index * 0
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        height, depth = height - top, depth - top
        below = fan**depth
        at = at + subtree_size(top, fan) + index // below * subtree_size(height, fan)
        index = index % below
    return at


@cache
def _stride(height: int, depth: int, fan: int) -> int:
    """Distance of siblings at a depth: the same throughout a level."""
    return int(address(height, depth, 1, fan) - address(height, depth, 0, fan))


def run_levels(total: int, fan: int = FAN) -> int:
    """Levels of runs above ``total`` nodes."""
    n = 0
    while total > 1:
        total, n = -(-total // fan), n + 1
    return n


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Block:
    """Nodes above neighbouring leaves, in one buffer."""

    def __init__(self, height: int, count: int, nodes: bytes | bytearray, fan: int = FAN):
        self.height, self.count, self.nodes, self.fan = height, count, nodes, fan

    @classmethod
    def build(cls, leaves: list[bytes], levels: int, fan: int = FAN) -> Block:
        height = levels + 1
        last = max(int(address(height, d, -(-len(leaves) // fan ** (levels - d)) - 1, fan)) for d in range(height))
        block = cls(height, len(leaves), bytearray((last + 1) * DIGEST), fan)
        for at, leaf in zip(address(height, levels, np.arange(len(leaves)), fan), leaves, strict=True):
            block.nodes[at * DIGEST : (at + 1) * DIGEST] = leaf
        for depth in range(levels - 1, -1, -1):
            for index in range(block.width(depth)):
                at = int(address(height, depth, index, fan))
                block.nodes[at * DIGEST : (at + 1) * DIGEST] = _digest(b"".join(block.run(depth + 1, index)))
        return block

    def width(self, depth: int) -> int:
        """Nodes at a depth."""
        return -(-self.count // self.fan ** (self.height - 1 - depth))

    def node(self, depth: int, index: int) -> bytes:
        at = int(address(self.height, depth, index, self.fan)) * DIGEST
        return bytes(self.nodes[at : at + DIGEST])

    def run(self, depth: int, parent: int) -> list[bytes]:
        """The children of the ``parent``-th node of the level above ``depth``."""
        first = parent * self.fan
        at, stride = int(address(self.height, depth, first, self.fan)), _stride(self.height, depth, self.fan)
        return [bytes(self.nodes[p * DIGEST : (p + 1) * DIGEST]) for p in range(at, at + min(self.fan, self.width(depth) - first) * stride, stride)]

    def siblings(self, depth: int, index: int) -> tuple[bytes, bytes]:
        """Digests before and after a node in its run."""
        run, own = self.run(depth, index // self.fan), index % self.fan
        return b"".join(run[:own]), b"".join(run[own + 1 :])


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    """Siblings level by level: how many stand before and after, then their digests."""
    return b"".join(bytes([len(a) // DIGEST, len(b) // DIGEST]) + a + b for a, b in path)


def read_path(packed: bytes) -> list[tuple[bytes, bytes]]:
    path, at = [], 0
    while at < len(packed):
        middle = at + 2 + packed[at] * DIGEST
        end = middle + packed[at + 1] * DIGEST
        path.append((packed[at + 2 : middle], packed[middle:end]))
        at = end
    return path


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        leaf = _digest(before + leaf + after)
    return leaf


def _build(levels: int, fan: int):
    """Sorted nodes (group, block, position, total, digest, doc_id, received) into one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            group, at, total = key
            block = Block.build([h[0] for h in held], min(levels, run_levels(total, fan)), fan)
            columns = [[group], [at], [total], [block.count], [bytes(block.nodes)], [block.node(0, 0)], [[h[1] for h in held]], [[h[2] for h in held]]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())], strict=True)
                ],
                names=["group", "block", "total", "count", "nodes", "digest", "doc_ids", "received"],
            )

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("group", "block", "total", "digest", "doc_id", "received")]
            for group, block, total, *rest in zip(*columns, strict=True):
                if (group, block, total) != key:
                    if held:
                        yield flush()
                    key, held = (group, block, total), []
                held.append(rest)
        if held:
            yield flush()

    return run


BLOCK = "group string, block long, total long, count long, nodes binary, digest binary, doc_ids array<long>, received array<binary>"


def _open_block(row: dict, levels: int, fan: int) -> Block:
    return Block(min(levels, run_levels(row["total"], fan)) + 1, row["count"], row["nodes"], fan)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[dict]:
    """Rows one at a time: a block is some hundred kilobytes, a batch may hold thousands."""
    for batch in batches:
        places = [batch.schema.get_field_index(n) for n in names]
        for k in range(batch.num_rows):
            yield {n: batch.column(p)[k].as_py() for n, p in zip(names, places, strict=True)}


def _hand_down(levels: int, fan: int):
    """(group, position, path) for every leaf of blocks that know their own path: its siblings up to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, "group", "block", "total", "count", "nodes", "path"):
            block, path = _open_block(row, levels, fan), []
            bottom = block.height - 1
            for index in range(block.count):
                own = [block.siblings(bottom - k, index // fan**k) for k in range(bottom)]
                path.append(pack_path(own) + row["path"])
                if len(path) == 1024 or index == block.count - 1:
                    first = row["block"] * fan**levels + index + 1 - len(path)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["group"]] * len(path), pa.string()), pa.array(range(first, first + len(path)), pa.int64()), pa.array(path, pa.binary())],
                        names=["group", "position", "path"],
                    )
                    path = []

    return run


def _prove(levels: int, fan: int):
    """A row for every leaf: its proof's digest, and the root that its received digest leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, "group", "block", "total", "count", "nodes", "path", "subroot", "root", "doc_ids", "received"):
            block, above = _open_block(row, levels, fan), read_path(row["path"])
            bottom, out = block.height - 1, []
            for first in range(0, block.count, fan):
                leaves = block.run(bottom, first // fan) if bottom else [block.node(0, 0)]
                upper = [block.siblings(bottom - k, first // fan**k) for k in range(1, bottom)] + above
                beyond = b"".join(a + b for a, b in upper)
                for k, leaf in enumerate(leaves):
                    own = [(b"".join(leaves[:k]), b"".join(leaves[k + 1 :]))] if bottom else []
                    proof = _digest(b"".join(a + b for a, b in own) + beyond)
                    folded = fold(row["received"][first + k] or leaf, own + upper)
                    out.append((row["doc_ids"][first + k], leaf, row["subroot"], row["root"], proof, folded, folded == row["root"]))
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            columns = [c.cast(pa.string()) if c.type == pa.binary() else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``position`` (from 0) in their group by ``order`` and the group's ``total``; equal rows in any order.

    Rows are range-sorted and stored with their places; only one count per slice and group is summed.
    """
    by = ["group", *order]
    numbered = store(nodes.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    parts = nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = numbered.repartitionByRange(int(parts), *by, "uid").sortWithinPartitions(*by, "uid").drop("uid")
    sorted_ = store(ranged.withColumn("mark", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mark", 33)), "merkle-sorted")
    discard(numbered)
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy("group", "part").agg(F.min("mark").alias("first"), F.count("*").alias("rows"))
    starts = counts.select(
        F.col("group").alias("of"), F.col("part").alias("in"), "first",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"),
        F.sum("rows").over(Window.partitionBy("group")).alias("total"),
    )
    starts = store(starts, "merkle-starts")
    joined = sorted_.join(starts, F.col("group").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    place = F.col("start") + F.col("mark") - F.col("first")
    return joined.select(*[c for c in sorted_.columns if c not in ("mark", "part")], place.alias("position"), "total")


def _forest(placed: DataFrame, levels: int, fan: int) -> list[DataFrame]:
    """Stored blocks, round by round; a group ends in the round in which it is one block."""
    size, rounds = fan**levels, []
    while True:
        keyed = placed.withColumn("block", F.floor(F.col("position") / F.lit(size)).cast("bigint"))
        sorted_ = keyed.repartition("group", "block").sortWithinPartitions("group", "block", "position")
        columns = ["group", "block", "total", "digest", "doc_id", "received"]
        blocks, seen = store_counted(sorted_.select(*columns).mapInArrow(_build(levels, fan), BLOCK), "merkle-blocks", most=F.max("total"))
        rounds.append(blocks)
        if (seen["most"] or 0) <= size:
            return rounds
        open_ = blocks.where(F.col("total") > size)
        placed = open_.select(
            "group", F.col("block").alias("position"), F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("total"), "digest",
            F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("received"),
        )


def _roots(rounds: list[DataFrame], levels: int, fan: int) -> DataFrame:
    """(group, digest): the root of every group."""
    ends = [b.where(F.col("total") <= fan**levels).select("group", "digest") for b in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def _paths_down(rounds: list[DataFrame], heads: DataFrame, levels: int, fan: int) -> DataFrame:
    """The blocks of the first round with ``path``, ``subroot`` and ``root``; ``heads`` has them for each group."""
    size, below = fan**levels, None
    named = heads.select(F.col("group").alias("of"), "path", "subroot", "root")
    for blocks in reversed(rounds):
        known = blocks.where(F.col("total") <= size).join(named, F.col("group").eqNullSafe(F.col("of"))).drop("of")
        if below is not None:
            paths = below.select("group", "block", "total", "count", "nodes", "path").mapInArrow(_hand_down(levels, fan), "group string, position long, path binary")
            paths = store(paths, "merkle-paths").select(F.col("group").alias("over"), F.col("position").alias("at"), F.col("path").alias("upper"))
            deep = blocks.where(F.col("total") > size).join(paths, F.col("group").eqNullSafe(F.col("over")) & (F.col("block") == F.col("at")))
            deep = deep.join(named.drop("path"), F.col("group").eqNullSafe(F.col("of")))
            known = known.select(*blocks.columns, "path", "subroot", "root").union(deep.select(*blocks.columns, "upper", "subroot", "root"))
        below = known
    return below


def leaf_digest(text: Column | None = None) -> Column:
    """SHA-256, as hex digits, of a row's fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for name in FIELDS:
        value = F.col(name).cast("string") if name != "text" or text is None else text
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest_proofs(docs: DataFrame, received: Column | None = None, tampered: Column | None = None, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs`` (doc_id, source, lang, n_chars, text).

    A manifest is built of the rows as they are: a leaf per row, a tree per source (null is a source of its own) with leaves
    ascending by doc_id, and one tree over the sources' roots. ``received`` is the text to be verified where ``tampered`` holds:
    its leaf is folded with the manifest's siblings, and ``verified`` tells if that leads to the root.

    Null ids come first; rows that share an id are ordered by their leaf, and equal rows are leaves of their own. Null and empty fields
    differ. A text of any length is one leaf. Other columns of ``docs``, whatever their names, are not read. No rows give no rows.
    """
    changed = F.lit(None).cast("binary") if received is None else F.when(F.lit(True) if tampered is None else tampered, leaf_digest(received).cast("binary"))
    made = docs.select(*FIELDS).select(F.col("source").alias("group"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest().cast("binary").alias("digest"), changed.alias("received"))
    sources = _forest(_placed(made, ["doc_id", "digest"]), levels, fan)
    subroots = store(_roots(sources, levels, fan), "merkle-subroots")

    # The sources' roots are the leaves of one more tree; "name" keeps which source a leaf is.
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    placed = store(_placed(named, ["name"]), "merkle-tops")
    tops = _forest(placed.select("*", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("received")), levels, fan)
    root = _roots(tops, levels, fan).select(F.col("digest").alias("root"))
    start = _roots(tops, levels, fan).select("group", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    paths = _paths_down(tops, start, levels, fan).select("group", "block", "total", "count", "nodes", "path", "root")
    down = paths.mapInArrow(_hand_down(levels, fan), "group string, position long, path binary")
    # One row: the root of everything.
    heads = placed.join(down.drop("group"), "position").join(F.broadcast(root)).select(F.col("name").alias("group"), "path", F.col("digest").alias("subroot"), "root")
    heads = store(heads, "merkle-heads")
    blocks = _paths_down(sources, heads, levels, fan)
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.mapInArrow(_prove(levels, fan), kind)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())


#: Levels of runs that the SQL below unrolls: 16^6 leaves.
SQL_LEVELS = 6


def manifest_sql() -> str:
    """The same rows in DuckDB's SQL: a table per level, and the siblings of every leaf joined level by level."""
    field = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar end"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    parts = [
        f"""d as (select doc_id, source, {leaf('text')} as leaf,
                  case when {crc32_sql('doc_id::varchar')} % 5 = 0 then {leaf(lowered)} else {leaf('text')} end as received from documents)""",
        "s0 as (select *, source as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p, leaf as h from d)",
        "a0 as (select g, p, h, count(*) over (partition by g) as n from s0)",
    ]

    def climb(kind: str) -> None:
        for k in range(1, SQL_LEVELS + 1):
            up = f"select g, p // 16 as p, sha256(string_agg(h, '' order by p)) as h from {kind}{k - 1} where n > 1 group by g, p // 16"
            parts.append(f"{kind}{k} as (select *, count(*) over (partition by g) as n from ({up}))")

    climb("a")
    ends = lambda kind: " union all ".join(f"select g, h from {kind}{k} where n = 1" for k in range(SQL_LEVELS + 1))
    parts += [
        f"subs as (select g as source, h as subroot, row_number() over (order by encode(g) nulls first) - 1 as p from ({ends('a')}))",
        "b0 as (select 0 as g, p, subroot as h, count(*) over () as n from subs)",
    ]
    climb("b")
    parts += [
        f"top as (select h as root from ({ends('b')}))",
        """f0 as (select s0.doc_id, leaf, subroot, s0.g, s0.p, subs.p as q, received as x, '' as proof
                  from s0 join subs on s0.g is not distinct from subs.source)""",
    ]
    at = 0
    for kind, g, p in (("a", "g", "p"), ("b", "0", "q")):
        for k in range(SQL_LEVELS):
            runs = f"(select g, p // 16 as r, list(h order by p) as hs, any_value(n) as n from {kind}{k} where n > 1 group by g, p // 16)"
            place = f"({p} // {16**k})"
            before = f"array_to_string(hs[1 : ({place} % 16)::int], '')"
            after = f"array_to_string(hs[({place} % 16)::int + 2 :], '')"
            parts.append(
                f"""f{at + 1} as (select f.* exclude (x, proof), case when hs is null then x else sha256({before} || x || {after}) end as x,
                      case when hs is null then proof else proof || {before} || {after} end as proof
                    from f{at} f left join {runs} r on r.g is not distinct from f.{g} and r.r = {place} // 16)""".replace("f.0", "0")
            )
            at += 1
    return f"""with {', '.join(parts)}
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, x as folded_root, x = root as verified from f{at}, top"""
