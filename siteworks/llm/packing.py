"""Pack tokenized documents into as few fixed-length sequences as possible.

*Reduction, then best fit.* Lengths are whole numbers up to ``capacity``, so an
instance of any size is a count for each length. On these counts the Martello-Toth
rules fix bins that dominate every other choice for their longest piece: a piece that
nothing fits beside goes alone; a partner that fills the bin exactly, or that is the
largest fitting one where no two others fit, or that outweighs every fitting pair,
is fixed with it, all copies at once. What they leave is packed longest first,
each piece into the fullest bin that still takes it. Bins with equal contents are kept
as one range with a count, so the work depends on the lengths, not on the pieces.

*Distribution.* Only that table of counts (``capacity`` rows at most) reaches the driver,
and only the resulting ranges go back. A piece finds its place from its rank among the
pieces of its length: a sum over buckets of a digest plus a rank within the bucket.
"""

from __future__ import annotations

import heapq
import os
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteworks.llm.common import row_key, slices, store_counted

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 4096
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 250_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts, word by word: this tokenizer never joins across white space, and words repeat.

    The few characters that only one of the two sides takes for white space send a text through whole.
    Two generations of known words are kept: when the young one is full it becomes the old.
    """

    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        # Tasks are parallel already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1 << 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, all at once: each is one unit to the tokenizer, and its last id says so."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words):
            return self._encode(words)
        joined, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if sys.byteorder == "little":
            return [array("I", e.ids).tobytes() for e in made]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        """A Latin word in lower case and the mark after it: the tokenizer keeps letters and marks apart, and lowers both."""
        core, tail = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        if not core.isalpha() or not core.isascii() and max(core) >= "\u0250":
            return word, ""
        return core if core.islower() else core.lower(), tail

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [None if any(c in t for c in self.ODD) else t.split() for t in texts]
        young, old = self.young, self.old
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        missing = set(chain.from_iterable(w for w in split if w)).difference(young)
        again = missing.intersection(old)
        young.update((w, old[w]) for w in again)
        missing -= again
        parts = [(word, *self._parts(word)) for word in missing]
        wanted = {core for _, core, _ in parts} | {tail for _, _, tail in parts if tail}
        unknown = list(wanted.difference(young))
        letters = [w for w in unknown if w.isalpha()]
        others = [w for w in unknown if not w.isalpha()]
        for words, encode in ((letters, self._encode_letters), (others, self._encode)):
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                young.update(zip(some, encode(some), strict=True))
        for word, core, tail in parts:
            if tail:
                young[word] = young[core] + young[tail]
            elif core is not word:
                young[word] = young[core]
        return [self._encode([t])[0] if words is None else b"".join(map(young.__getitem__, words)) for t, words in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(path)
        for batch in slices(batches, 1024):
            docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for doc, row, ids in zip(docs, rows, ids_of(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    values = (doc, row, k, at // 4, len(piece) // 4, crc32(piece))
                    out.append((*values, np.frombuffer(piece, dtype="<u4").astype(np.int32)) if with_ids else values)
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"][: 7 if with_ids else 6]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

    return run


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32 [, ids]): every document's ids and the end id, cut where they exceed ``capacity``.

    A null text is empty: its one piece is the end id.
    """
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")
    return keyed.mapInArrow(_pieces(path or tokenizer_path(), capacity, with_ids), schema)


#: A range of the places of one length: ranks lo.. lo + n, ``each`` to a bin, from bin ``first`` and offset ``offset`` on.
Range = tuple[int, int, int, int, int, int]


class _Plan:
    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.ranges: list[Range] = []
        self.bins = 0

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def put(self, length: int, n: int, each: int, first: int, offset: int) -> None:
        self.ranges.append((length, self.used[length], n, each, first, offset))
        self.used[length] += n
        self.left[length] -= n


def reduce_instance(plan: _Plan, capacity: int) -> None:
    """Fix the bins that dominate, longest pieces first."""
    sizes = sorted(s for s in plan.left if plan.left[s])  # those with copies left, ascending

    def drop(s: int) -> None:
        if not plan.left[s]:
            sizes.pop(bisect_left(sizes, s))

    def largest(room: int, spare: int = 0) -> int | None:
        """Largest length up to ``room`` with copies left; one copy of ``spare`` is taken already."""
        i = bisect_left(sizes, room + 1) - 1
        while i >= 0 and plan.left[sizes[i]] - (sizes[i] == spare) <= 0:
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest_two(spare: int) -> int | None:
        found = []
        for s in sizes[:3]:
            found += [s] * min(2, plan.left[s] - (s == spare))
        return sum(found[:2]) if len(found) > 1 else None

    for j in list(reversed(sizes)):
        while plan.left[j]:
            room = capacity - j
            k = largest(room, j)
            if k is None:
                n = plan.left[j]
                plan.put(j, n, 1, plan.open(n), 0)
                drop(j)
                break
            two = smallest_two(j)
            best_pair = 0
            if k < room and two is not None and two <= room:
                # The heaviest pair that fits; with three or more pieces beside j nothing is said.
                least = sizes[0]
                if two + least <= room:
                    break
                for s in sizes:
                    if 2 * s > room:
                        break
                    if plan.left[s] - (s == j) > 0 and (t := largest(room - s, s)) is not None:
                        best_pair = max(best_pair, s + t)
            if k < room and best_pair > k:
                break
            n = plan.left[j] // 2 if k == j else min(plan.left[j], plan.left[k])
            first = plan.open(n)
            plan.put(j, n, 1, first, 0)
            plan.put(k, n, 1, first, j)
            drop(j)
            if k != j:
                drop(k)


def best_fit(plan: _Plan, capacity: int) -> None:
    """Longest first, each piece into the fullest bin that takes it; equal bins are handled together."""
    rooms: list[int] = []  # distinct free rooms, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # free room: ranges of bins (first, count)

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            heapq.heappush(groups[room], (first, n))

    for s in sorted((s for s in plan.left if plan.left[s]), reverse=True):
        while plan.left[s]:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                n = -(-plan.left[s] // each)
                add(capacity, plan.open(n), n)
                continue
            room = rooms[i]
            first, n = heapq.heappop(groups[room])
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = room // s  # a bin stays the fullest that fits until it no longer takes the piece
            full = min(n, plan.left[s] // each)
            if full:
                plan.put(s, full * each, each, first, capacity - room)
                add(room - each * s, first, full)
            rest = plan.left[s] if full < n else 0
            if rest:
                plan.put(s, rest, rest, first + full, capacity - room)
                add(room - rest * s, first + full, 1)
                full += 1
            add(room, first + full, n - full)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Range], int]:
    """Ranges of places for ``counts`` pieces of each length, and the number of bins."""
    plan = _Plan({s: n for s, n in counts.items() if n})
    reduce_instance(plan, capacity)
    best_fit(plan, capacity)
    return plan.ranges, plan.bins


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (row, piece, length, ...) with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    Sequences have no gaps: offsets start at 0 and follow one another. Equal rows get places of their own.
    """
    columns = pieces.columns
    stored, seen = store_counted(pieces, "pieces", rows=F.count(F.lit(1)))
    buckets = seen["rows"] // BUCKET_ROWS + 1
    keyed = stored.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    totals = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("length").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = stored.groupBy("length").agg(F.count("*").alias("n"))
    ranges, _ = plan_bins({r["length"]: r["n"] for r in counts.collect()}, capacity)
    places = pieces.sparkSession.createDataFrame(ranges, "size long, lo long, n long, each long, first long, at long")

    order = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    ranked = keyed.withColumn("inner", F.row_number().over(order) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("of")) & (F.col("bucket") == F.col("in"))).withColumn("rank", F.col("base") + F.col("inner"))
    # One list of ranges for each length: a table bounded by ``capacity``, whatever the data.
    lists = places.groupBy(F.col("size").alias("of_size")).agg(F.sort_array(F.collect_list(F.struct("lo", "n", "each", "first", "at"))).alias("ranges"))
    found = ranked.join(F.broadcast(lists), F.col("length") == F.col("of_size"))
    found = found.withColumn("r", F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["lo"] + r["n"]))[0])
    y = F.col("rank") - F.col("r.lo")
    nth = F.floor(y / F.col("r.each")).cast("bigint")
    offset = F.col("r.at") + F.pmod(y, F.col("r.each")) * F.col("length")
    return found.select(*columns, (F.col("r.first") + nth).alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. No documents give no rows."""
    return pack_pieces(cut_documents(docs, capacity, path), capacity).drop("row")


def build_sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most ``capacity`` ids each."""
    placed = pack_pieces(cut_documents(docs, capacity, path, with_ids=True), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
