"""Sets of whole-number ids as bitmaps: one small row for 32,768 neighbouring ids.

A set is a row per bucket of ids with a bit per id. Bits are set on the map side, so what is shuffled is a row per
bucket and task, however often an id stands. Sets meet bucket by bucket: union, intersection,
difference and their sizes need no id to move, and only the resulting ids are written out again.

That pays while ids are dense. ``dense_enough`` counts buckets first; sparse ids (random
numbers, say) would fill a bitmap each, and are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids in a bucket: fixed by Spark's bitmap functions, which count buckets of positive ids from 1.
BITS = 32768
#: Ids a bucket holds at least, on average, for a bitmap of 4 kB to be smaller than the ids.
LEAST_PER_BUCKET = 512


def bitmaps(df: DataFrame, key: str) -> DataFrame:
    """``bucket, bits`` of the non-null ids of ``df``."""
    ids = df.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("at"))
    return ids.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def merged(*sets: DataFrame) -> DataFrame:
    """The union of sets: also how a stored set takes in new ids."""
    rows = sets[0]
    for other in sets[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def size(df: DataFrame, name: str = "n") -> DataFrame:
    """One row: how many ids a set holds."""
    return df.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))


def _has(bits: Column, at: Column) -> Column:
    """Whether the bit at a place is set; a missing bitmap has none."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, at.bitwiseAND(7)) == 1, F.lit(False))


def _ids(rows: DataFrame, key: str, wanted) -> DataFrame:
    """The ids of the places that ``wanted`` selects."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), wanted))
    found = rows.select("*", at.alias("at"))
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + F.col("at") + 1).otherwise(F.col("bucket") * BITS - F.col("at"))
    return found.select(number.cast("bigint").alias(key))


def ids_of(bitmap: DataFrame, key: str) -> DataFrame:
    return _ids(bitmap, key, lambda at: _has(F.col("bits"), at))


def _side_by_side(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.select("bucket", "bits").join(right.select("bucket", F.col("bits").alias("other")), "bucket", how)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of the first set that the second lacks."""
    return _ids(_side_by_side(left, right, "left"), key, lambda at: _has(F.col("bits"), at) & ~_has(F.col("other"), at))


def intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return _ids(_side_by_side(left, right, "inner"), key, lambda at: _has(F.col("bits"), at) & _has(F.col("other"), at))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``n_left, n_right, n_both``, from the sizes of the sets and of their union: no id is written out."""
    both = left.select("bucket", "bits", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("bucket", "bits", F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = F.bitmap_count("bits")
    per = both.groupBy("bucket").agg(F.sum(n * F.col("l")).alias("l"), F.sum(n * F.col("r")).alias("r"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total("l").alias("n_left"), total("r").alias("n_right"), total(F.col("l") + F.col("r") - F.col("either")).alias("n_both"))


def dense_enough(df: DataFrame, key: str) -> bool:
    """Whether the ids of a table fill their buckets well enough; buckets are counted by a mergeable sketch."""
    ids = df.where(F.col(key).isNotNull())
    got = ids.agg(F.approx_count_distinct(key).alias("ids"), F.approx_count_distinct(F.bitmap_bucket_number(key)).alias("buckets")).first()
    return got["ids"] >= LEAST_PER_BUCKET * got["buckets"]


def missing_ids(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct non-null ids of ``source`` that ``done`` lacks; bitmaps where the ids are dense, else a join."""
    if dense_enough(source, key):
        return difference(bitmaps(source, key), bitmaps(done, key), key)
    wanted = source.where(F.col(key).isNotNull()).select(key).distinct()
    return wanted.join(done.select(key), key, "left_anti")
