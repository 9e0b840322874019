"""Text-rating enrichment: batches, prompts, response parsing, audit and resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteworks.functions.columns import all_present
from siteworks.functions.ratings import RATING_DEFAULTS, RATING_SCALES, RATINGS
from siteworks.operators.ordering import ordered_positions

PROMPT_FIELDS = ["funder", "installer", "ward", "subvillage", "scheme_name"]

# Label of each field in a prompt record.
FIELD_TITLES = {
    "funder": "Funder",
    "installer": "Installer",
    "ward": "Ward",
    "subvillage": "Subvillage",
    "scheme_name": "Scheme",
}

# The fields each rating looks at when rated alone.
RATING_FIELDS = {
    "funder_org_type": ["funder"],
    "installer_quality": ["installer"],
    "location_type": ["ward", "subvillage"],
    "scheme_pattern": ["scheme_name"],
    "text_language": ["funder", "ward", "subvillage"],
    "coordination": ["funder", "installer"],
}

# Prices per million tokens and service limits per minute.
INPUT_PRICE, OUTPUT_PRICE = 0.4, 1.6
REQUESTS_PER_MINUTE, TOKENS_PER_MINUTE = 500, 200000


def scale_text(rating: str) -> str:
    return ", ".join(f"{i}={name}" for i, name in enumerate(RATING_SCALES[rating], start=1))


def assign_batches(df: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Batch number from 1 and position within the batch, in key order."""
    placed = ordered_positions(df, [key], "position")
    zero = F.col("position") - 1
    return (
        placed.withColumn("batch", (F.floor(zero / F.lit(size)) + 1).cast("bigint"))
        .withColumn("pos", (F.pmod(zero, F.lit(size)) + 1).cast("int"))
        .drop("position")
    )


def _joined(order: str, line: str) -> Column:
    """Lines of one batch (at most its size) in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")


def vertical_header() -> str:
    lines = ["Rate each record on six scales from 1 to 5; use 3 when unsure."]
    lines += [f"{i}. {name}: {scale_text(name)}" for i, name in enumerate(RATINGS, start=1)]
    return "\n".join([*lines, "Records:"])


def vertical_footer() -> str:
    keys = ", ".join(f'"{name}"' for name in ["id", *RATINGS])
    return f'Answer with a JSON object whose "results" array has one object per record, in order, with keys {keys}.'


def vertical_prompts(batched: DataFrame) -> DataFrame:
    """``batch, n_rows, prompt``: all six ratings for the rows of a batch."""
    parts = [F.col("pos").cast("string"), F.lit(". ID: "), F.col("id").cast("string")]
    for field in PROMPT_FIELDS:
        parts += [F.lit(f"\n   {FIELD_TITLES[field]}: "), F.coalesce(F.col(field), F.lit("MISSING"))]
    return (
        batched.select("batch", "pos", F.concat(*parts).alias("line"))
        .groupBy("batch")
        .agg(F.count("*").alias("n_rows"), _joined("pos", "line").alias("body"))
        .select(
            "batch", "n_rows", F.concat(F.lit(vertical_header() + "\n"), F.col("body"), F.lit("\n" + vertical_footer())).alias("prompt")
        )
    )


def field_line(rating: str) -> Column:
    parts = []
    for i, field in enumerate(RATING_FIELDS[rating]):
        parts += [F.lit((", " if i else "") + FIELD_TITLES[field] + ": "), F.coalesce(F.col(field), F.lit("nan"))]
    return F.concat(*parts)


def horizontal_prompts(batched: DataFrame) -> DataFrame:
    """``batch, rating, n_rows, prompt``: one rating for the rows of a batch."""
    number = F.concat(F.col("pos").cast("string"), F.lit(". "))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("rating"),
                F.lit(f"Rate {name} ({scale_text(name)}):\n\n").alias("head"),
                F.concat(number, field_line(name)).alias("line"),
            )
            for name in RATINGS
        ]
    )
    return (
        batched.select("batch", "pos", F.inline(entries))
        .groupBy("batch", "rating", "head")
        .agg(F.count("*").alias("n_rows"), _joined("pos", "line").alias("body"))
        .select(
            "batch", "rating", "n_rows", F.concat("head", "body", F.lit("\n\nOutput only numbers 1-5, one per line.")).alias("prompt")
        )
    )


def single_prompts(df: DataFrame) -> DataFrame:
    """``id, rating, prompt``: one rating of one row per prompt."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("rating"),
                F.concat(F.lit(f"Rate {name} ({scale_text(name)}):\n"), field_line(name), F.lit("\nOutput only a number 1-5.")).alias("prompt"),
            )
            for name in RATINGS
        ]
    )
    return df.select("id", F.inline(entries))


def repair_json(text: Column) -> Column:
    """Complete a truncated last rating with 3, then close open braces and brackets."""
    body = F.regexp_replace(F.trim(text), r'"coordination":\s*$', '"coordination": 3')
    braces = F.regexp_count(body, F.lit(r"\{")) - F.regexp_count(body, F.lit(r"\}"))
    brackets = F.regexp_count(body, F.lit(r"\[")) - F.regexp_count(body, F.lit(r"\]"))
    none = F.lit(0)
    # Innermost first: the open record, then its list, then the object around the list.
    outer = F.when((brackets > 0) & (braces > 0) & body.startswith("{"), F.lit(1)).otherwise(none)
    inner = F.greatest(none, braces - outer)
    return F.concat(body, F.repeat(F.lit("}"), inner), F.repeat(F.lit("]"), F.greatest(none, brackets)), F.repeat(F.lit("}"), outer))


def response_items(text: Column) -> Column:
    """Items of a response as array<map<string,string>>; null when it is not JSON.

    Accepted: an object with ``results``, an object whose single key holds the list, a
    bare list, or one bare item. Values are read as text, so one bad field cannot
    void the rest of its item.
    """
    items = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    fields = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    wrapped = F.from_json(F.coalesce(fields["results"], F.when(F.size(fields) == 1, F.map_values(fields)[0])), items)
    bare_list = F.when(F.ltrim(text).startswith("["), F.from_json(text, items))
    bare_item = F.when((F.size(fields) > 1) & ~F.map_contains_key(fields, "results"), F.array(fields))
    return F.coalesce(wrapped, bare_list, bare_item)


def clamp_rating(value: Column, default: int) -> Column:
    number = value.try_cast("double")
    number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(number, F.lit(float(default)))))


def normalize_responses(requested: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per requested ``(batch, id)`` with six ratings and a status.

    ``responses`` has ``batch, response`` rows, several per batch where a request was repeated; an id
    takes its best answer: intact before repaired, then the first text in order. Ids outside the
    batch are ignored, repeated ids of an answer count once (the first), and what is missing, not a
    number or infinite takes the fall-back values.
    Status: ``ok``, ``repaired``, ``absent`` (row missing) or ``failed`` (not readable).
    """
    # A batch has a handful of ids, so they travel with its responses: one join, one parse.
    asked = requested.groupBy("batch").agg(F.collect_set("id").alias("ids"))
    parsed = (
        asked.join(responses, "batch", "left")
        .withColumn("direct", response_items(F.col("response")))
        .withColumn("items", F.coalesce("direct", response_items(repair_json(F.col("response")))))
        .select("batch", "ids", "items", "response", F.col("direct").isNotNull().alias("intact"))
    )
    matches = F.filter("items", lambda x: x["id"].try_cast("bigint") == F.col("id"))
    matched = parsed.select("batch", "items", "intact", "response", F.explode("ids").alias("id")).withColumn("item", F.get(matches, F.lit(0)))
    rank = F.when(F.col("items").isNull(), 3).when(F.col("item").isNull(), 2).when(F.col("intact"), 0).otherwise(1)
    values = F.struct(*[F.col("item")[n].alias(n) for n in RATINGS])
    best = matched.groupBy("batch", "id").agg(F.min(F.struct(rank.alias("rank"), "response", values.alias("values"))).alias("best"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("ok", "repaired", "absent", "failed")]), F.col("best.rank") + 1)
    return best.select(
        "batch", "id", *[clamp_rating(F.col("best.values")[n], RATING_DEFAULTS[n]).alias(n) for n in RATINGS], status.alias("status")
    )


def parse_rating_lines(requested: DataFrame, responses: DataFrame) -> DataFrame:
    """One rating per expected position from a line-per-row answer; else 3.

    Extra lines are cut by the join from the expected positions, missing ones padded.
    """
    lines = responses.select("batch", F.posexplode(F.split(F.trim("response"), "\n")).alias("line_no", "line")).select(
        "batch", (F.col("line_no") + 1).cast("int").alias("pos"), F.trim("line").try_cast("int").alias("value")
    )
    value = F.when(F.col("value").between(1, 5), F.col("value")).otherwise(3)
    return requested.select("batch", "pos", "id").join(lines, ["batch", "pos"], "left").select("batch", "pos", "id", value.alias("rating"))


def parse_digit(text: Column) -> Column:
    value = F.trim(text).try_cast("int")
    return F.when(value.between(1, 5), value).otherwise(3)


def is_valid_digit(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("int").between(1, 5), F.lit(False))


def reprocess_ids(source: DataFrame, ratings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ids without a complete rating row: never rated, or rated with gaps."""
    complete = ratings.where(all_present(columns)).select("id")
    return source.select("id").join(complete, "id", "left_anti")


def completeness_audit(source: DataFrame, ratings: DataFrame, columns: Sequence[str], batch_size: int = 5) -> DataFrame:
    """One row: complete, incomplete and missing ids, progress, remaining batches, cost, minutes."""
    state = ratings.select("id", F.when(all_present(columns), 1).otherwise(0).alias("complete"))
    joined = source.select("id").join(state, "id", "left")
    counts = joined.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("complete"), F.lit(0)).cast("bigint").alias("complete"),
        F.sum(F.col("complete").isNull().cast("bigint")).alias("missing"),
    )
    todo = F.col("total") - F.col("complete")
    # Cost per batch and batches per minute of the estimate.
    return counts.select(
        "total",
        "complete",
        "missing",
        (todo - F.col("missing")).alias("incomplete"),
        todo.alias("to_process"),
        (F.try_divide(F.col("complete").cast("double"), F.col("total").cast("double")) * 100).alias("percent_done"),
        F.ceil(todo / F.lit(batch_size)).cast("bigint").alias("remaining_batches"),
        (F.ceil(todo / F.lit(batch_size)) * F.lit(0.0001)).alias("estimated_cost"),
        (F.ceil(todo / F.lit(batch_size)) / F.lit(100.0)).alias("estimated_minutes"),
    )


def request_plan(df: DataFrame, text_columns: Sequence[str], vertical_size: int, horizontal_size: int) -> DataFrame:
    """Requests, tokens, cost and minutes of the three layouts, from the texts themselves.

    A token is counted as four characters. Layouts: one rating of one row per request,
    one rating of many rows, all ratings of many rows.
    """
    ratings = len(RATINGS)
    text_tokens = F.lit(0)
    for name in text_columns:
        text_tokens = text_tokens + F.length(F.coalesce(F.col(name), F.lit("MISSING")))
    total = df.select(F.ceil(text_tokens / F.lit(4)).alias("tokens")).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens")
    )
    # Tokens around the data of one request, and answer tokens per rating.
    single_head, list_head, table_head, answer = 60, 60, 600, 2
    rows, tokens = F.col("rows"), F.col("tokens")

    def layout(name: str, requests: Column, head: int, per_rating: int) -> Column:
        return F.struct(
            F.lit(name).alias("layout"),
            requests.cast("bigint").alias("requests"),
            (requests * F.lit(head) + tokens * F.lit(per_rating)).cast("bigint").alias("input_tokens"),
            (rows * F.lit(ratings * answer)).cast("bigint").alias("output_tokens"),
        )

    layouts = F.array(
        layout("single", rows * F.lit(ratings), single_head, ratings),
        layout("horizontal", F.ceil(rows / F.lit(horizontal_size)) * F.lit(ratings), list_head, ratings),
        layout("vertical", F.ceil(rows / F.lit(vertical_size)), table_head, 1),
    )
    by_requests = F.col("requests") / F.lit(float(REQUESTS_PER_MINUTE))
    by_tokens = (F.col("input_tokens") + F.col("output_tokens")) / F.lit(float(TOKENS_PER_MINUTE))
    return (
        total.select(F.inline(layouts))
        .withColumn("cost", (F.col("input_tokens") * F.lit(INPUT_PRICE) + F.col("output_tokens") * F.lit(OUTPUT_PRICE)) / F.lit(1e6))
        .withColumn("minutes", F.greatest(by_requests, by_tokens))
        .withColumn("bottleneck", F.when(by_requests > by_tokens, "requests").otherwise("tokens"))
    )


def spot_check(df: DataFrame, field: str, rating: str, expected: Sequence[tuple[str, int]]) -> DataFrame:
    """Per pattern: matching rows and the share rated as expected, in one pass."""
    cells = []
    for pattern, value in expected:
        hit = F.coalesce(F.lower(field).contains(pattern), F.lit(False))
        agreed = F.when(hit, F.when(F.col(rating) == value, 1.0).otherwise(0.0))
        cells.append(
            F.struct(
                F.lit(pattern).alias("pattern"),
                F.lit(value).alias("expected"),
                F.sum(hit.cast("bigint")).alias("n"),
                F.avg(agreed).alias("agreement"),
            )
        )
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def enrich_with(
    batched: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: Sequence[str]
) -> DataFrame:
    """Run a user's scorer on Arrow batches of rows: the place of a model call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield scorer(frame)

    return batched.select(*columns).mapInPandas(run, schema)
