"""Helpers shared by the operators: tables, stored intermediates, byte hashing and linked groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siteworks.session import scratch_path

#: Bytes of text that are hashed at once: bounds the arrays of a task whatever the size of a document.
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch that are handled at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that a Python worker holds at once, and Spark on its side of the pipe.
BATCH_BYTES = 8 << 20


@contextmanager
def _bounded(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files when they end, and pass small batches to Python workers."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives a lost executor.

    The table is what later steps read, so the shuffles that made it leave nothing behind.
    """
    path = scratch_path(df.sparkSession, label)
    with _bounded(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates observed while it is written."""
    seen = Observation()
    stored = store(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), label)
    return stored, seen.get


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(stored: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    folders = {path.rsplit("/", 1)[0] for path in stored.inputFiles()}
    for folder in folders:
        drop_folder(stored.sparkSession, folder)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    while base in used:
        base += "_"
    return base


def row_key() -> Column:
    """A key for a row by its content: equal rows share it, and equal results then hold for both."""
    return F.xxhash64("doc_id", "text")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all 64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ByteHash:
    """Hashes of any substrings of a buffer from one running sum.

    A byte's code is weighted by a power of an odd number, so the difference of two
    running sums, shifted back, depends on the bytes between them only.
    """

    def __init__(self, seed: int, fold: np.ndarray | None = None):
        codes = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed))
        self.codes = codes if fold is None else codes[fold]
        self.base = (0x9E3779B97F4A7C15 + 2 * 7919 * seed) % 2**64 | 1
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, CHUNK_BYTES + 4096)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.down[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.up[start]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of them is small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal keys; a run may go on over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
        start = 0
        for at in range(batch.num_rows):
            if key[at] != last:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], at, key[at]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def chunks(texts: list[bytes], overlap: int | None = None, limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in runs of about ``limit`` bytes; longer ones in parts that share ``overlap`` bytes, or whole if that is None.

    Yields the index of each part's text, where in the text the part starts, and the parts.
    """
    index: list[int] = []
    starts: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        whole = overlap is None or len(text) <= limit
        step = len(text) + 1 if whole else limit - overlap
        for start in [0] if whole else range(0, len(text) - overlap, step):
            part = text if whole else text[start : start + step + overlap]
            if parts and size + len(part) > limit:
                yield index, starts, parts
                index, starts, parts, size = [], [], [], 0
            index.append(i)
            starts.append(start)
            parts.append(part)
            size += len(part)
    if parts:
        yield index, starts, parts


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text's UTF-8 bytes: bit by bit, from the lowest of each byte."""
    bits = f"flatten(list_transform(range(0, octet_length(encode({text}))), lambda i: list_transform(range(0, 8), lambda j: (('0x' || substr(hex(encode({text})), 2 * i::int + 1, 2))::int >> j::int) & 1)))"
    step = "xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))"
    return f"xor(4294967295, list_reduce(list_transform(list_prepend(4294967295, {bits}), lambda x: x::bigint), lambda crc, bit: {step}))"


def components(edges: DataFrame, label: str) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (a, b): columns node, root.

    Every round each node takes the smallest root among its neighbours, then its
    root's root, so chains shrink fast; it ends when nothing changes. Minima are
    combined before the shuffle, so a node with many neighbours stays cheap.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    roots = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{label}-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far")).where("next <> far")
        stepped = lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("before"))
        after, seen = store_counted(stepped, f"{label}-roots", changed=F.count_if(F.col("root") != F.col("before")))
        discard(roots)
        roots = after.select("node", "root")
        if not seen["changed"]:
            discard(both)
            return roots
