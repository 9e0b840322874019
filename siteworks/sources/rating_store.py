"""The keyed rating table on plain Parquet: append per batch, merge on read, compact.

Rewriting a large table for every small batch would cost the whole table each
time. A batch is written once into its own folder below its writer's, so it is all or
nothing; readers take the latest row per id; ``compact`` folds batches into the buckets of a
base that they touch, and readers switch to it with the manifest that names them.

The store stays cheap as it ages. A manifest names only what its version adds and what it makes
obsolete; every ``FULL_EVERY`` versions one names everything, so a reader opens a bounded chain. What became obsolete ``KEEP``
versions ago is removed, folded batches included. A bucket that outgrows ``BUCKET_ROWS`` is split by one
more bit of the hash. So a read makes calls for the buckets, the chain and the batches not yet folded only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteworks.functions.ratings import RATINGS
from siteworks.sources.tables import path_exists

RATING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(f"rating_{name}", T.DoubleType()) for name in RATINGS],
        T.StructField("batch_completed", T.IntegerType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)
#: Bits of the hash that name a bucket of a new store.
FIRST_BITS = 4
HASH_BITS = 30
#: Rows from which a bucket is split.
BUCKET_ROWS = 1_000_000
#: Versions between manifests that name everything, and versions for which obsolete files stay for readers.
FULL_EVERY = 16
KEEP = 2
RATING_COLUMNS = [f"rating_{name}" for name in RATINGS]


def latest_per_id(versions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key by ``order``; combines on the map side, so hot keys stay cheap.

    Rows that are equal in ``order`` are compared as a whole, so the result never depends on
    how they were read. The row is no fixed-width value, so each task sorts before it combines.
    """
    payload = [c for c in versions.columns if c != key]
    rest = [c for c in payload if c not in order]
    newest = versions.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("row"))
    return newest.select(key, *[F.col("row")[c].alias(c) for c in payload])


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Latest wins by batch, then time. Id 0 is a fall-back marker and never stored."""
    both = current.unionByName(incoming).where(F.col(key) != 0)
    return latest_per_id(both, key, ["batch_completed", "timestamp"])


class RatingStore:
    """Batches of several writers, folded into a base by hash bucket.

    ``batches/<writer>/<batch>-<attempt>`` holds what a writer stored under a number; storing it again
    adds an attempt, and readers take the last complete one. ``base/<n>/bucket=<bits>`` holds folded
    rows whose hash starts with these bits. ``manifests/<n>`` is published by one rename that fails if another
    compaction was faster, so readers see either the old base or the new; every
    folder that is not listed as folded is read beside it, whatever its number.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS, keep: int = KEEP):
        self.spark = spark
        self.path = path.rstrip("/")
        self.bucket_rows, self.keep = bucket_rows, keep

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        folder, fs = self._folder(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _remove(self, name: str) -> None:
        folder, fs = self._folder(name)
        fs.delete(folder, True)

    def _versions(self) -> list[str]:
        return [n for n in self._names("manifests") if not n.startswith(("_", "."))]

    def _load(self, names: Sequence[str]) -> list[dict]:
        if not names:
            return []
        texts = self.spark.read.text([f"{self.path}/manifests/{n}" for n in names], wholetext=True).collect()
        return sorted((json.loads(t[0]) for t in texts), key=lambda m: m["version"])

    def _state(self) -> dict:
        """What the chain of manifests says: version, where each bucket lies, its rows, and the folded folders that may still exist."""
        names = self._versions()
        full = max((k for k, n in enumerate(names) if n.endswith("-full")), default=0)
        state = {"version": 0, "buckets": {}, "rows": {}, "folded": {}}
        for m in self._load(names[full:]):
            if m["full"]:
                state["buckets"], state["rows"], state["folded"] = {}, {}, {}
            for bits in m["replaced"]:
                state["buckets"].pop(bits, None)
                state["rows"].pop(bits, None)
            state["buckets"] |= m["buckets"]
            state["rows"] |= m["rows"]
            state["folded"] |= m["folded"]
            state["version"] = m["version"]
        return state

    def _unfolded(self, state: dict) -> list[str]:
        """The last complete attempt of every writer's batches that is not folded yet, as paths below the store."""
        found: dict[tuple[str, str], tuple[int, str]] = {}
        for writer in self._names("batches"):
            for name in self._names(f"batches/{writer}"):
                path, (number, attempt) = f"batches/{writer}/{name}", name.split("-")
                if path not in state["folded"] and path_exists(self.spark, f"{self.path}/{path}/_SUCCESS"):
                    found[writer, number] = max(found.get((writer, number), (0, "")), (int(attempt), path))
        return sorted(path for _, path in found.values())

    def _rows(self, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RATING_SCHEMA)
        return self.spark.read.schema(RATING_SCHEMA).parquet(*[f"{self.path}/{p}" for p in paths])

    def write_batch(self, rows: DataFrame, batch: int, writer: str = "main") -> None:
        """Store one batch of a writer; writing it again replaces it once it is complete."""
        typed = rows.where(F.col("id") != 0).select(*[F.col(f.name).cast(f.dataType) for f in RATING_SCHEMA])
        number = f"{batch:012d}"
        known = {*self._names(f"batches/{writer}"), *(p.rsplit("/", 1)[1] for p in self._state()["folded"] if p.startswith(f"batches/{writer}/"))}
        tried = [int(n.split("-")[1]) for n in known if n.split("-")[0] == number]
        typed.write.parquet(f"{self.path}/batches/{writer}/{number}-{max(tried, default=0) + 1:04d}")

    def read(self) -> DataFrame:
        """Current rows; an empty, typed frame when nothing is stored yet."""
        state = self._state()
        stored = self._rows([*state["buckets"].values(), *self._unfolded(state)])
        return latest_per_id(stored, "id", ["batch_completed", "timestamp"])

    @staticmethod
    def _bucket(labels: Sequence[str]) -> Column:
        """The one label that a row's hash starts with."""
        bits = F.lpad(F.bin(F.pmod(F.xxhash64("id"), F.lit(1 << HASH_BITS))), HASH_BITS, "0")
        return F.filter(F.array(*[F.lit(b) for b in sorted(labels)]), lambda b: F.startswith(bits, b))[0]

    def _split(self, labels: Sequence[str], rows: dict[str, int]) -> list[str]:
        """The labels, with those that would outgrow a bucket cut by further bits; halves are taken to be even."""
        out, todo = [], [(b, rows.get(b, 0)) for b in labels]
        while todo:
            bits, n = todo.pop()
            if n > self.bucket_rows and len(bits) < HASH_BITS:
                todo += [(bits + "0", n // 2), (bits + "1", n // 2)]
            else:
                out.append(bits)
        return sorted(out)

    def compact(self) -> None:
        """Fold the batches that are not in the base yet; only buckets that they touch are written anew."""
        state = self._state()
        fresh = self._unfolded(state)
        if not fresh:
            return
        version, added = state["version"] + 1, self._rows(fresh)
        labels = list(state["buckets"]) or [f"{k:0{FIRST_BITS}b}" for k in range(1 << FIRST_BITS)]
        if state["buckets"]:  # buckets without a row yet have no folder, but keep their place
            labels = self._cover(labels)
        # A row per bucket.
        more = {r[0]: r[1] for r in added.groupBy(self._bucket(labels)).count().collect()}
        touched = sorted(more)
        parts = self._split(touched, {b: state["rows"].get(b, 0) + n for b, n in more.items()})
        old = [b for b in touched if b in state["buckets"]]
        base, counts = f"base/{version:012d}-{uuid.uuid4().hex}", {}
        if touched:  # else all batches are empty, and only their names are folded
            merged = latest_per_id(self._rows([state["buckets"][b] for b in old]).unionByName(added), "id", ["batch_completed", "timestamp"])
            merged.withColumn("bucket", self._bucket(parts)).write.partitionBy("bucket").parquet(f"{self.path}/{base}")
            written = self.spark.read.schema(T.StructType([*RATING_SCHEMA, T.StructField("bucket", T.StringType())])).parquet(f"{self.path}/{base}")
            counts = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}
        made = {b: f"{base}/bucket={b}" for b in counts}
        folded = {path: version for path in fresh}
        text = {"version": version, "full": False, "replaced": old, "buckets": made, "rows": counts, "folded": folded, "obsolete": [*fresh, *(state["buckets"][b] for b in old)]}
        if version % FULL_EVERY == 0:
            still = {p: v for p, v in (state["folded"] | folded).items() if v > version - self.keep}
            kept = {b: p for b, p in state["buckets"].items() if b not in old}
            text |= {"full": True, "buckets": kept | made, "rows": {b: state["rows"][b] for b in kept} | counts, "folded": still}
        self._publish(f"{version:012d}" + "-full" * text["full"], json.dumps(text))
        self._clean(version)

    @staticmethod
    def _cover(labels: Sequence[str]) -> list[str]:
        """The labels, and the places of hashes that none of them starts."""
        out, todo = [], [""]
        while todo:
            bits = todo.pop()
            if bits in labels or len(bits) >= FIRST_BITS and not any(b.startswith(bits) for b in labels):
                out.append(bits)
            else:
                todo += [bits + "0", bits + "1"]
        return sorted(out)

    def _clean(self, version: int) -> None:
        """Remove what became obsolete ``keep`` versions ago, and manifests that no chain needs."""
        names = self._versions()
        full = max((k for k, n in enumerate(names) if n.endswith("-full")), default=0)
        old = [n for n in names if int(n.split("-")[0]) <= version - self.keep]
        for m in self._load(old):
            for path in m["obsolete"]:
                self._remove(path)
        for name in old:
            if name in names[:full]:
                self._remove(f"manifests/{name}")
        used = {p.split("/")[1] for p in self._state()["buckets"].values()}
        for folder in self._names("base"):  # a version's folder goes when none of its buckets is left
            if folder not in used and int(folder.split("-")[0]) <= version - self.keep:
                self._remove(f"base/{folder}")

    def _publish(self, name: str, text: str) -> None:
        """Write beside, then rename: the rename refuses to replace a manifest of the same version."""
        taken = [n for n in self._versions() if n.split("-")[0] == name.split("-")[0]]
        beside, fs = self._folder(f"manifests/.{name}-{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            if taken:
                raise RuntimeError(f"manifest {taken[0]} is there already")
            files.rename(fs.makeQualified(beside), fs.makeQualified(self._folder(f"manifests/{name}")[0]), options)
        except Exception as error:
            fs.delete(beside, False)
            raise RuntimeError(f"manifest {name} was written by another compaction") from error

    def progress(self) -> DataFrame:
        return progress_state(self.read())


def progress_state(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count("*").alias("rows"), F.coalesce(F.max("batch_completed"), F.lit(0)).alias("last_batch")
    )
