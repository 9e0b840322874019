"""Mix sources to target weights along a curriculum, with DataFrame functions only.

Targets fill up like water: each source takes its weight's share, but never more than
``cap`` times its size; what is over goes to the others by weight. A source's documents
stand in an order given by a digest of their ids and texts and are read over and over until the
target is reached: all of them in every full pass, those at the front in the last.

*Curriculum.* A source's weight changes over training time ``t`` in 0..1 as a straight
line, by its place in the list of sources rising, level or falling. The integral of that
line is the share of the source's words that are due by ``t``; solving it for ``t`` at a
document's place in the cumulative demand gives the document's training position.

*Scale.* Running sums over a source are taken in two steps: over the documents of a
bucket of the order, and over the buckets' totals. The number of buckets follows the
number of rows, so a source with a third of all rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.llm.common import store_counted

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Weight of a source at the end of training over that at its start; by place in the list of sources.
SLOPES = (0.5, 1.0, 2.0)
BUCKET_ROWS = 1024
#: A number of buckets at most: the digest's first eight hex digits choose one.
DIGITS = 8


def _digest() -> Column:
    """Where a row stands among those of its source: by its id and text, so that rows without an id, or with a shared one, are spread too."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def _place(c: str) -> Column:
    return F.conv(F.substring(c, 1, DIGITS), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, source_size): one small row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1).cast("int")
    cycle = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), turn % len(values) + 1)
    s = sizes.select("source", "source_size", cycle(weights).alias("weight"), cycle(SLOPES).alias("slope"))
    # Sources reach their cap in the order of cap over weight; k of them are full at the level that holds.
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    fits = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    limit = (cap * F.col("source_size")).cast("double")
    s = s.withColumn("level", level)
    return s.select("source", "source_size", "weight", "slope", F.least(F.col("level") * F.col("weight"), limit).alias("target"))


def due_at(share: Column, slope: Column) -> Column:
    """Training time 0..1 at which a share of a source's words is due: the integral of its weight line, inverted.

    The line runs from 2 / (1 + r) to 2r / (1 + r), so its integral over 0..1 is 1.
    """
    start, rise = 2 / (1 + slope), 2 * (slope - 1) / (1 + slope)
    return F.when(slope == 1, share).otherwise((F.sqrt(start * start + 2 * rise * share) - start) / rise + 0.0)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, position), sorted by position, for every row of ``docs`` (doc_id, text, source).

    Other columns are not read, whatever their names; texts of any length are counted whole.

    ``size`` counts words; ``taken`` is how many of them the mix takes, repeats counted; ``position`` is the
    training time of a document's first word, null if nothing is taken. Null and empty texts have
    size 0 and are never taken; a null source is a source of its own, the last. Rows that
    share a doc_id are separate documents; equal rows stand in any order among themselves. No rows give no rows.
    """
    return _planned(docs, weights, cap).drop("digest").orderBy("position", "doc_id")


def _planned(docs: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """The same in any order, with ``digest``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    made = docs.select("doc_id", "source", size.alias("size"), _digest().alias("digest"))
    rows, seen = store_counted(made, "sizes", rows=F.count(F.lit(1)))
    buckets = seen["rows"] // BUCKET_ROWS + 1
    rows = rows.withColumn("bucket", F.floor(_place("digest") * buckets / 16**DIGITS).cast("bigint"))

    totals, _ = store_counted(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "bucket-sizes", rows=F.count(F.lit(1)))
    targets = source_targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    plan = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(base["source"], "bucket", "base", "source_size", "slope", "target")
    # In a bucket, rows follow their digest. Both windows and the join use one partitioning.
    order = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0))).alias("r")
    placed = summed.join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    ahead = F.col("base") + F.col("inner")
    whole = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    last = whole - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last - ahead))
    due = due_at(F.least(ahead / F.col("target"), F.lit(1.0)), F.col("slope"))
    out = placed.select(
        "doc_id", "size", F.col("r.source").alias("source"), "source_size", "target", taken.cast("bigint").alias("taken"), due.alias("due"), "digest"
    )
    position = F.when(F.col("taken") > 0, F.col("due"))
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", position.alias("position"), "digest")


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: a row for each pass over a document, with its columns; the last pass may hold its first words only.

    Documents of which nothing is taken go; a text that is cut ends with its last word taken. ``n_chars``, where there is one, is counted anew.
    Rows that share id, text and source are numbered, and each takes what the mix gives the row of that number. Extra columns are returned as they
    are, whatever their names. Null and empty texts are never taken. No rows give no rows.
    """
    same = ["digest", "source"]
    number = lambda by: F.row_number().over(Window.partitionBy(*same).orderBy(by))
    plan = _planned(docs, weights, cap).select(*same, "size", "taken")
    plan = plan.withColumn("nth", number(F.desc("taken"))).where("taken > 0")
    plan = plan.select(F.col("digest").alias("of"), F.col("source").alias("in"), F.col("nth").alias("place"), "size", "taken")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text", "source", _digest().alias("digest"))
    rows = rows.withColumn("nth", number(F.col("digest")))
    passes = F.expr("transform(sequence(1, int(ceil(taken / size))), k -> least(size, taken - (k - 1) * size))")
    joined = rows.join(plan, (F.col("digest") == F.col("of")) & F.col("source").eqNullSafe(F.col("in")) & (F.col("nth") == F.col("place")))
    each = joined.select("doc", "text", "size", F.explode(passes).alias("words"))
    # What follows the words taken is the last part of a split into one part more (two if the text starts with space).
    rest = F.expr(rf"element_at(split(text, r'{SPACE}', int(words) + if(text rlike r'^{SPACE}', 2, 1)), -1)")
    cut = F.regexp_replace(F.substring("text", F.lit(1), F.length("text") - F.length(rest)), rf"{SPACE}$", "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return each.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def mix_sql(weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> str:
    """The same rows in DuckDB's SQL, over whole windows."""
    cycle = "list_extract([" + ", ".join(f"{float(w)}" for w in weights) + f"], (turn % {len(weights)})::int + 1)"
    slopes = "list_extract([" + ", ".join(f"{s}" for s in SLOPES) + f"], (turn % {len(SLOPES)})::int + 1)"
    return f"""
    with d as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
             md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as digest from documents),
    g as (select source, sum(size)::bigint as source_size from d group by source),
    n as (select *, row_number() over (order by source nulls last) - 1 as turn from g),
    w as (select source, source_size, {cycle}::double as weight, {slopes}::double as slope from n),
    l as (
      select *, (sum(source_size) over () - {cap} * coalesce(sum(source_size) over (
                  order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
                / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as lv
      from w),
    t as (
      select source, source_size, slope,
             least((select min_by(lv, source_size / weight) from l where lv * weight <= {cap} * source_size) * weight,
                   ({cap} * source_size)::double) as target from l),
    c as (
      select d.doc_id, d.size, t.source, t.source_size, t.slope, t.target, floor(t.target)::bigint as whole,
             coalesce(sum(d.size) over (partition by d.source order by d.digest, d.doc_id, d.size
                                        rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
      from d join t on d.source is not distinct from t.source),
    p as (
      select *, case when source_size > 0 then whole // source_size else 0 end as passes from c),
    k as (
      select *, (passes * size + greatest(0, least(size, whole - passes * source_size - ahead)))::bigint as taken,
             least(ahead / target, 1.0) as share, 2 / (1 + slope) as first, 2 * (slope - 1) / (1 + slope) as rise from p)
    select doc_id, size, source_size, target, taken,
           case when taken > 0 then round(case when slope = 1 then share else (sqrt(first * first + 2 * rise * share) - first) / rise + 0.0 end, 9) end as position
    from k
    """
