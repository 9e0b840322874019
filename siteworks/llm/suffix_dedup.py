"""Removal of long byte strings that repeat anywhere in a corpus.

The suffixes of the corpus, cut at ``length`` bytes, are taken bucket by bucket; two
suffixes that are equal to that depth mark a repeat. No text is moved for it beyond
what may repeat, and no bucket has to fit into one task:

1. *Buckets.* The smallest gram hash within a suffix's first ``window`` grams is its
   bucket. Equal suffixes have equal buckets, at the same distance from that gram.
   Neighbouring suffixes of a bucket form one stretch, so a document has about
   ``2 / window`` rows a byte. Buckets with one stretch hold no repeat and end here.
2. *Long ties.* Equal stretches of a bucket are equal throughout: all their suffixes
   repeat. A long copy is settled by this, in counts that combine before the shuffle.
3. *Cover sample.* Only stretches that differ somewhere are read again. Positions
   whose distance from the gram lies in a difference cover of ``period`` are ranked by
   their next ``length - period + 1`` bytes; that string lies within every suffix up
   to ``period - 1`` bytes before it. A rank held once ends its suffixes; one held by
   equal blocks marks all of them.
4. *The rest*, some suffixes at either end of a copy, are ordered within their rank by
   the few bytes around the ranked string: suffixes with equal rank and equal bytes tie.

Ranks are two 64-bit hashes of the bytes, so equal ranks mean equal strings but for a
chance of 2^-128 a pair. A bucket as hot as a third of all rows only adds to counts.

Where shorter strings are wanted as well, they are searched first, and the longer ones
inside the runs they cover: a long repeat lies in one of those in all its places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.llm.common import ByteHash, chunks, discard, mix, row_key, signed, slices, store, text_bytes

LENGTH = 400
WINDOW = 257
PERIOD = 57
#: A passage in words: more than 50 of them, which are 204 bytes if words have three letters, and the sizes to search such strings with.
PASSAGE_WORDS = 50
PASSAGE = {"length": 204, "window": 141, "period": 29}
#: Positions are packed as start * 2^20 + (suffixes - 1) * 2^10 + distance of the gram.
PACK = 1 << 10


def difference_cover(period: int) -> list[int]:
    """Residues of which some pair has every difference modulo ``period``: greedy, in order of gain."""
    cover, missing = [0], set(range(1, period))
    while missing:
        def gain(r: int) -> int:
            return len(missing & ({(r - c) % period for c in cover} | {(c - r) % period for c in cover}))

        best = max(range(period), key=lambda r: (gain(r), -r))
        missing -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


def _lowest(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` neighbouring values."""
    blocks = -(-len(values) // window)
    padded = np.full((blocks, window), np.iinfo(np.uint64).max, dtype=np.uint64)
    padded.ravel()[: len(values)] = values
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(values) - window + 1
    return np.minimum(right[:last], left[window - 1 : window - 1 + last])


def _stretches(length: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    gram = length - window + 1
    low = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteHash(1), ByteHash(2)
        for batch in slices(batches):
            rows, texts = batch.column(0).to_numpy(zero_copy_only=False), text_bytes(batch.column(1))
            for index, starts, parts in chunks(texts, overlap=length - 1):
                sizes = np.array([len(p) for p in parts])
                data = np.frombuffer(b"".join(parts), dtype=np.uint8)
                if len(data) < length:
                    continue
                begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                sums = first.sums(data)
                at = np.arange(len(data) - gram + 1)
                grams = mix(first.spans(sums, at, at + gram))
                gram_at = (_lowest((grams & ~low) | at.astype(np.uint64), window) & low).astype(np.int64)
                part = np.repeat(np.arange(len(parts)), sizes)[: len(gram_at)]
                inside = np.arange(len(gram_at)) + length <= (begins + sizes)[part]
                new = np.ones(len(gram_at), dtype=bool)
                new[1:] = (gram_at[1:] != gram_at[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(gram_at)) - 1
                lo, hi = lo[inside[lo]], hi[inside[lo]]
                if not len(lo):
                    continue
                off, count = gram_at[lo] - lo, hi - lo + 1
                shape = (off * PACK + count).astype(np.uint64)
                whole = mix(second.spans(second.sums(data), lo, hi + length) ^ mix(shape))
                own = np.asarray(starts)[part[lo]] + lo - begins[part[lo]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[np.asarray(index)[part[lo]]], pa.int64()),
                        pa.array(own * PACK * PACK + (count - 1) * PACK + off, pa.int64()),
                        signed(grams[gram_at[lo]]),
                        signed(whole),
                    ],
                    names=["row", "place", "bucket", "whole"],
                )

    return run


def _shared(rows: DataFrame, bucket: str, member: str, label: str) -> DataFrame:
    """Rows of buckets that weigh more than one, stored; ``mixed`` where their members differ.

    The totals are stored before, so that the join has two plain shuffles as sides and Spark can split a hot bucket.
    """
    total = rows.groupBy(bucket).agg(F.sum("weight").alias("total"), F.min(member).alias("m0"), F.max(member).alias("m1"))
    kept = total.where("total > 1").select(bucket, (F.col("m0") != F.col("m1")).alias("mixed"))
    totals = store(kept, f"{bucket}-totals")
    shared = store(rows.join(totals, bucket), label)
    discard(totals)
    return shared


def _blocks(length: int, period: int) -> Column:
    """The suffixes of a stretch by the next cover position: structs of that position and the first and last suffix.

    All are counted from the stretch's gram, so equal suffixes meet at equal positions.
    """
    cover = difference_cover(period)
    gaps = {c: (c - cover[i - 1]) % period or period for i, c in enumerate(cover)}
    gap_of = F.create_map(*[F.lit(x).cast("bigint") for pair in gaps.items() for x in pair])
    first, last = -F.col("off"), F.col("count") - 1 - F.col("off")
    at = F.filter(F.sequence(first, last + period - 1), lambda p: F.pmod(p, F.lit(period).cast("bigint")).isin(cover))
    made = F.transform(
        at,
        lambda p: F.struct(
            p.alias("p"),
            F.greatest(p - F.element_at(gap_of, F.pmod(p, F.lit(period).cast("bigint"))) + 1, first).alias("s"),
            F.least(p, last).alias("e"),
        ),
    )
    return F.filter(made, lambda b: b["s"] <= b["e"])


def _piece(start: Column, size: Column | int) -> Column:
    return F.substring(F.col("bytes"), (start + 1).cast("int"), F.lit(size) if isinstance(size, int) else size.cast("int"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(row, spans): the byte ranges of every row that lie in a string of ``length`` bytes which starts anywhere else too.

    ``docs`` has ``row`` and ``text`` (or its bytes); ``spans`` are sorted, apart from one another, structs (start, end). The result
    is stored; what it was made from is removed as soon as nothing reads it any more.
    """
    made = docs.select("row", "text").mapInArrow(_stretches(length, window), "row long, place long, bucket long, whole long")
    rows = _shared(made.withColumn("weight", F.lit(1)), "bucket", "whole", "stretches")
    span = [
        "row",
        F.shiftright("place", 20).alias("start"),
        (F.shiftright("place", 20) + F.shiftright("place", 10).bitwiseAND(PACK - 1) + length).alias("end"),
    ]
    settled = rows.where("not mixed").select(*span)
    mixed = rows.where("mixed")
    kinds = store(
        mixed.groupBy("bucket", "whole").agg(F.count("*").alias("weight"), F.min(F.struct("row", "place")).alias("one")), "stretch-kinds"
    )
    copied = mixed.join(kinds.where("weight > 1").select("bucket", "whole"), ["bucket", "whole"]).select(*span)
    long_ties = store(settled.union(copied), "long-ties")
    discard(rows)

    # One text for each kind of stretch in a mixed bucket.
    asked = kinds.select(
        F.col("one.row").alias("row"),
        F.shiftright("one.place", 20).alias("start"),
        (F.shiftright("one.place", 10).bitwiseAND(PACK - 1) + 1).alias("count"),
        F.col("one.place").bitwiseAND(PACK - 1).alias("off"),
        "bucket",
        F.least("weight", F.lit(2)).alias("weight"),
    )
    texts = store(
        asked.join(docs.select("row", F.col("text").cast("binary").alias("bytes")), "row").select(
            *asked.columns, _piece(F.col("start"), F.col("count") + length - 1).alias("bytes")
        ),
        "stretch-texts",
    )
    discard(kinds)
    depth = length - period + 1
    b = texts.select("row", "start", "off", "bucket", "weight", "bytes", F.explode(_blocks(length, period)).alias("b"))
    ranked = b.select(
        "row", "start", "off", "weight",
        (F.col("b.s") + F.col("off")).alias("s"),
        (F.col("b.e") + F.col("off")).alias("e"),
        F.xxhash64("bucket", "b.p", _piece(F.col("b.p") + F.col("off"), depth)).alias("rank"),
        F.xxhash64(F.lit(1), "b.s", _piece(F.col("b.s") + F.col("off"), F.col("b.e") - F.col("b.s") + length)).alias("block"),
    )
    blocks = _shared(ranked, "rank", "block", "cover-ranks")
    own = blocks.where("weight = 1")
    at = ["row", (F.col("start") + F.col("s")).alias("start"), (F.col("start") + F.col("e") + length).alias("end")]
    even = own.where("not mixed").select(*at)
    tied = blocks.where("mixed").groupBy("rank", "block").agg(F.sum("weight").alias("ties"))
    ties = store(tied, "block-ties")
    judged = store(blocks.where("mixed").join(ties, ["rank", "block"]), "cover-ties")
    discard(ties)
    equal = judged.where("weight = 1 and ties > 1").select(*at)

    # What is left of a block: each suffix by its rank and the bytes before and after the ranked string.
    held = judged.join(texts.select("row", "start", "bytes"), ["row", "start"])
    held = held.select("row", "start", "weight", "rank", "bytes", F.explode(F.sequence("s", "e")).alias("i"))
    suffixes = held.select(
        "row", (F.col("start") + F.col("i")).alias("at"), "weight",
        F.xxhash64("rank", _piece(F.col("i"), length)).alias("head"),
        F.xxhash64(F.lit(2), _piece(F.col("i"), length)).alias("tail"),
    )
    suffixes = store(suffixes, "suffixes")
    discard(texts)
    same = suffixes.groupBy("head", "tail").agg(F.sum("weight").alias("ties")).where("ties > 1")
    tails = store(same, "suffix-ties")
    ends = suffixes.where("weight = 1").join(tails, ["head", "tail"]).select("row", F.col("at").alias("start"), (F.col("at") + length).alias("end"))

    spans = store(_merged(long_ties.union(even).union(equal).union(ends)), "spans")
    for stored in (long_ties, blocks, judged, suffixes, tails):
        discard(stored)
    return spans


def spans_within(docs: DataFrame, wide: DataFrame, length: int, window: int, period: int) -> DataFrame:
    """``repeated_spans`` of ``docs`` from ``wide``, those of a smaller length: only their bytes are searched.

    All shorter strings in a repeated string repeat too, so it lies in one wide span, in all its places.
    """
    long = F.explode(F.filter("spans", lambda s: s["end"] - s["start"] >= length)).alias("s")
    cut = F.substring(F.col("text").cast("binary"), (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int"))
    parts = docs.join(wide.select("row", long), "row").select(
        F.xxhash64("row", "s.start").alias("row"), F.col("row").alias("of"), F.col("s.start").alias("begin"), cut.alias("text")
    )
    parts = store(parts, "span-texts")
    found = repeated_spans(parts.select("row", "text"), length, window, period)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("begin")).alias("start"), (s["end"] + F.col("begin")).alias("end")))
    placed = found.join(parts.select("row", "of", "begin").distinct(), "row").select(F.col("of").alias("row"), moved.alias("spans"))
    spans = store(placed.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    discard(parts)
    discard(found)
    return spans


def _merged(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.distinct().select("row", "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("fresh"))
    runs = fresh.select("row", "start", "end", F.sum("fresh").over(order).alias("run"))
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, period: int = PERIOD, words: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, ...) with columns ``kept`` (binary), ``spans``, ``n_bytes``, ``n_removed`` and ``n_spans``.

    Every byte inside a string of ``length`` bytes that also starts at any other
    place of the corpus goes, in all places, judged on the input. A null text is empty;
    texts shorter than ``length`` are kept whole; a row that stands twice repeats
    itself and loses all of a text of ``length`` bytes or more. Columns of ``docs`` with
    these names are replaced, all others kept whatever their names. No rows give no rows.
    With ``words``, only spans of more words than that go.
    """
    keyed = _keyed(docs, SPANS)
    joined = keyed.join(repeated_spans(keyed.select("row", "text"), length, window, period), "row", "left")
    joined = joined.withColumn("spans", _some("spans"))
    if words:
        joined = joined.withColumn("spans", _of_words("spans", words))
    return joined.select("doc.*", *_cut())


def remove_repeats_and_passages(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, period: int = PERIOD, words: int = PASSAGE_WORDS, passage: dict[str, int] = PASSAGE
) -> DataFrame:
    """The same as ``remove_repeats`` with columns ``passages`` and ``rest`` in addition.

    ``passages`` are the spans of more than ``words`` words that strings of ``passage["length"]`` bytes cover which start at other
    places too; ``rest`` is what is left of the text without ``spans`` and ``passages``. ``length`` must not be smaller.
    """
    keyed = _keyed(docs, [*SPANS, "passages", "rest"])
    texts = keyed.select("row", "text")
    wide = repeated_spans(texts, **passage)
    spans = spans_within(texts, wide, length, window, period)
    both = wide.withColumnRenamed("spans", "passages").join(spans, "row", "left")
    joined = keyed.join(both, "row", "left").withColumn("spans", _some("spans")).withColumn("passages", _some("passages"))
    joined = joined.withColumn("passages", _of_words("passages", words))
    inside = lambda s: F.exists("passages", lambda p: (p["start"] <= s["start"]) & (s["end"] <= p["end"]))
    gone = F.array_sort(F.concat("passages", F.filter("spans", lambda s: ~inside(s))))
    return joined.withColumn("gone", gone).select("doc.*", *_cut(), "passages", _rest("gone").alias("rest"))


SPANS = ["kept", "spans", "n_bytes", "n_removed", "n_spans"]


def _keyed(docs: DataFrame, made: list[str]) -> DataFrame:
    own = [c for c in docs.columns if c not in made]
    return docs.select(F.struct(*own).alias("doc"), "text", row_key().alias("row"))


def _some(spans: str) -> Column:
    return F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _raw() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))


def _part(start: Column, end: Column) -> Column:
    return F.substring(_raw(), (start + 1).cast("int"), (end - start).cast("int"))


def _of_words(spans: str, words: int) -> Column:
    """The spans of more than ``words`` words."""
    return F.filter(spans, lambda s: F.regexp_count(_part(s["start"], s["end"]).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")) > words)


def _rest(spans: str) -> Column:
    """The bytes of the text outside its spans."""
    size = F.octet_length(_raw()).cast("bigint")
    rest = F.aggregate(
        spans,
        F.struct(F.lit("").cast("binary").alias("b"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["b"], _part(acc["at"], s["start"])).alias("b"), s["end"].alias("at")),
        lambda acc: F.concat(acc["b"], _part(acc["at"], size)),
    )
    return F.when(F.size(spans) == 0, _raw()).otherwise(rest)


def covered(spans: str) -> Column:
    """Bytes that the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def _cut() -> list[Column]:
    return [
        _rest("spans").alias("kept"),
        F.col("spans"),
        F.octet_length(_raw()).cast("bigint").alias("n_bytes"),
        covered("spans").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
    ]


def kept_text(kept: str = "kept") -> Column:
    """What ``remove_repeats`` left (or a column like it), as text. A cut may fall inside a character; what is left of it is no text and goes too."""
    valid = F.make_valid_utf8(F.col(kept).cast("string"))
    part = F.when(F.contains("text", F.lit("\uFFFD")), valid).otherwise(F.replace(valid, F.lit("\uFFFD"), F.lit("")))
    return F.when(F.octet_length(kept) < F.col("n_bytes"), part).otherwise(F.col("text"))


def drop_passages(docs: DataFrame, words: int = PASSAGE_WORDS, length: int = PASSAGE["length"], window: int = PASSAGE["window"], period: int = PASSAGE["period"]) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, ...) without passages of more than ``words`` words that stand anywhere else too; ``n_chars`` is counted anew.

    A passage is what strings of ``length`` bytes cover that start at other places too; shorter runs of words, such as phrases, stay. All other
    columns are as they are. Texts that lose nothing stay as they are, null ones null. Repeated rows lose such texts in all copies. No rows give no rows.
    """
    packed = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text")
    done = remove_repeats(packed, length, window, period, words)
    new = {"text": kept_text(), "n_chars": F.length(kept_text()).cast("bigint")}
    return done.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])
