"""Quality rules as a short-circuit cascade.

*Base.* Counts that every document gets, from arrays over the bytes of many texts at once: words, their code points, symbols,
lines seen before, and words in windows that stand twice.

*Cascade.* Each further rule may only reject, so the verdict does not depend on the order and a document can leave at the
first rule it fails. How long a rule takes and what it rejects is measured on a bounded sample that
passes the base. The rule with the most rejections per second comes first; the next is chosen by what it
rejects of the sample documents still there, so a rule that repeats another's work moves back.

*Scale.* One pass over the texts without a shuffle, after the sample. Each text is read in parts; what is held
beyond it is eight bytes a word.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.llm.common import ByteHash, mix

LEAST_WORDS = 20
#: Words of a window, and the percentage of words in repeated ones from which a document fails.
WINDOW = 8
MOST_REPEATED = 30
SYMBOLS = b"#*$%&|<>"
#: Documents that costs and rejections are measured on, at most about.
SAMPLE_ROWS = 4000
#: Bytes of texts that are handled at once; a longer text is alone, in parts of about so many bytes.
PART_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = regex.compile(r"\p{L}")
_UPPER = regex.compile(r"\p{Lu}")


class Text:
    """A document as the rules see it; what a rule does not ask for is not computed."""

    def __init__(self, raw: bytes, n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_lines: int):
        self.raw = raw
        self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_lines = n_words, word_chars, n_symbols, n_dup_lines, n_lines

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def string(self) -> str:
        return self.raw.decode(errors="replace")

    @cached_property
    def ends(self) -> list[bytes]:
        """First word and last character or two of each line with a word."""
        return [line for line in map(bytes.strip, self.raw.split(b"\n")) if line]


@dataclass(frozen=True)
class Rule:
    """A reason to reject a document; ``sql`` says the same of the columns of ``quality_sql``."""

    name: str
    rejects: Callable[[Text], bool]
    sql: str


def _plain_words(t: Text) -> int:
    return sum(1 for w in t.words if _LETTER.search(w.decode(errors="replace")))


def _share_of_capitals(t: Text) -> bool:
    capitals = len(_UPPER.findall(t.string))
    return 5 * capitals > 2 * t.word_chars or (5 * capitals > t.word_chars and 5 * capitals > 2 * len(_LETTER.findall(t.string)))


#: Lines that start with one of these are items of a list.
BULLETS = ("•", "‣", "-", "*")
ELLIPSES = ("...", "…")
_BULLETS = tuple(b.encode() for b in BULLETS)
_ELLIPSES = tuple(e.encode() for e in ELLIPSES)


def _either(column: str, test: str, values: Sequence[str]) -> str:
    return " or ".join(f"{test}({column}, '{v}')" for v in values)


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, "10 * n_symbols > n_words"),
    Rule("word_length", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words, "not (word_chars between 3 * n_words and 10 * n_words)"),
    Rule("repeated_lines", lambda t: 5 * t.n_dup_lines > 2 * t.n_lines, "5 * n_dup_lines > 2 * len(lines)"),
    Rule("few_letters", lambda t: 10 * _plain_words(t) < 8 * t.n_words, "10 * len(list_filter(words, lambda w: regexp_matches(w, '\\p{L}'))) < 8 * n_words"),
    Rule("capitals", _share_of_capitals, "5 * n_capitals > 2 * word_chars or (5 * n_capitals > word_chars and 5 * n_capitals > 2 * n_letters)"),
    Rule("stutter", lambda t: 10 * sum(a == b for a, b in zip(t.words, t.words[1:])) > t.n_words, "10 * n_stutters > n_words"),
    Rule("few_distinct", lambda t: len(set(t.words)) ** 2 < t.n_words, "len(list_distinct(words)) ** 2 < n_words"),
    Rule(
        "cut_lines",
        lambda t: 10 * sum(line.endswith(_ELLIPSES) for line in t.ends) > 3 * t.n_lines,
        f"10 * len(list_filter(lines, lambda x: {_either('x', 'ends_with', ELLIPSES)})) > 3 * len(lines)",
    ),
    Rule(
        "bullets",
        lambda t: 10 * sum(line.startswith(_BULLETS) for line in t.ends) > 9 * t.n_lines,
        f"10 * len(list_filter(lines, lambda x: {_either('x', 'starts_with', BULLETS)})) > 9 * len(lines)",
    ),
)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words; white space of any kind may end them."""
    at = 0
    while len(text) - at > PART_BYTES:
        end = min((e for e in (text.find(bytes([s]), at + PART_BYTES) for s in (0x20, *range(0x09, 0x0E))) if e >= 0), default=-1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class _Counts:
    """Base counts of some texts; parts of a text may be added one after another."""

    def __init__(self, size: int, hasher: ByteHash):
        self.words, self.chars, self.symbols = (np.zeros(size, dtype=np.int64) for _ in range(3))
        self.hasher = hasher
        self.owners: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []

    def add(self, index: np.ndarray, parts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
        first = np.cumsum([1, *[len(p) + 1 for p in parts]])
        space = _SPACE[data]
        edges = np.flatnonzero(np.diff(space.view(np.int8)))  # a word begins after, ends after
        begin, end = edges[::2] + 1, edges[1::2] + 1
        sums = self.hasher.sums(data)
        owner = index[np.searchsorted(first, begin, side="right") - 1]
        self.owners.append(owner)
        self.hashes.append(mix(self.hasher.spans(sums, begin, end) + (end - begin).astype(np.uint64)))
        size = len(self.words)
        self.words += np.bincount(owner, minlength=size)
        for counts, chosen in ((self.chars, ~space & ((data & 0xC0) != 0x80)), (self.symbols, _SYMBOL[data])):
            at = np.flatnonzero(chosen)
            counts += np.bincount(index[np.searchsorted(first, at, side="right") - 1], minlength=size)

    def repeated(self, window: int) -> np.ndarray:
        """Words that lie in a window of ``window`` words that the text holds twice or more."""
        owner, words = np.concatenate(self.owners), np.concatenate(self.hashes)
        size = len(words) - window + 1
        out = np.zeros(len(self.words), dtype=np.int64)
        if size < 2:
            return out
        key = mix(owner[:size].astype(np.uint64))
        for k in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size]
        key = mix(key)
        at = np.flatnonzero(owner[:size] == owner[window - 1 :])
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        again = order[np.append(same, False) | np.append(False, same)]
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + window, -1)
        return out + np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=len(out))


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def base_counts(texts: list[bytes], hasher: ByteHash) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of every text."""
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}

    def put(index: list[int], chunks: Iterator[tuple[np.ndarray, list[bytes]]]) -> None:
        counts = _Counts(len(index), hasher)
        for part in chunks:
            counts.add(*part)
        for name, values in (("n_words", counts.words), ("word_chars", counts.chars), ("n_symbols", counts.symbols), ("n_repeat_words", counts.repeated(WINDOW))):
            out[name][index] = values

    held: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > PART_BYTES:
            put([i], ((np.zeros(1, dtype=np.int64), [p]) for p in _parts(text)))
            continue
        if held and size + len(text) > PART_BYTES:
            put(held, iter([(np.arange(len(held)), [texts[k] for k in held])]))
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        put(held, iter([(np.arange(len(held)), [texts[k] for k in held])]))
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    return out | {"n_lines": lines[:, 0], "n_dup_lines": lines[:, 1]}


def _failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def _judged(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray, Callable[[int], Text]]]:
    """Rows in small batches with their base counts, whether they fail the base, and the documents for the rules."""
    hasher = ByteHash(7)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            texts = [t or b"" for t in rows.column(column).to_pylist()]
            base = base_counts(texts, hasher)

            def text(k: int, texts=texts, base=base) -> Text:
                return Text(texts[k], *(int(base[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")))

            yield rows, base, _failed(base), text


def _measure(rules: Sequence[Rule]):
    """For a sample: nanoseconds of every rule, and how many documents fail each set of rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, sets = [0] * len(rules), Counter()
        for _, _, failed, text in _judged(batches, 0):
            for k in np.flatnonzero(~failed):
                mask = 0
                for i, rule in enumerate(rules):
                    alone = text(k)  # as if no other rule had prepared anything
                    started = time.perf_counter_ns()
                    mask |= rule.rejects(alone) << i
                    spent[i] += time.perf_counter_ns() - started
                sets[mask] += 1
        rows = [(mask, n, [0] * len(rules)) for mask, n in sets.items()] + [(0, 0, spent)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["mask", "n", "spent"],
        )

    return run


def by_rejection_per_cost(costs: Sequence[float], sets: dict[int, int]) -> list[int]:
    """Order of rules: each next one rejects the most, per cost, of what those before it leave; ``sets`` counts documents by the bits of the rules they fail."""
    left, order = dict(sets), []
    rest = list(range(len(costs)))
    while rest:
        gain = {i: sum(n for mask, n in left.items() if mask >> i & 1) for i in rest}
        best = min(rest, key=lambda i: (-gain[i] / max(costs[i], 1e-9), costs[i], i))
        order.append(best)
        rest.remove(best)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return order


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order they should run in over ``docs`` (text, ...), by a sample of about ``sample_rows`` rows at most."""
    rows = docs.count()
    if not rows:
        return list(rules)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    sample = texts if rows <= sample_rows else texts.sample(fraction=sample_rows / rows, seed=13)
    measured = sample.mapInArrow(_measure(rules), "mask long, n long, spent array<long>")
    total = [F.sum(F.col("spent")[i]).alias(f"spent_{i}") for i in range(len(rules))]
    # A row for each set of rules that some document fails: 2 ** len(rules) at most.
    found = measured.groupBy("mask").agg(F.sum("n").alias("n"), *total).collect()
    sets = {r["mask"]: r["n"] for r in found if r["n"]}
    costs = [sum(r[f"spent_{i}"] for r in found) / max(1, sum(sets.values())) for i in range(len(rules))]
    return [rules[i] for i in by_rejection_per_cost(costs, sets)]


def _cascade(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, base, failed, text in _judged(batches, 1):
            kept = ~failed
            for k in np.flatnonzero(kept):
                document = text(k)
                kept[k] = not any(rule.rejects(document) for rule in rules)
            counts = [pa.array(base[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            names = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(failed), pa.array(kept)], names=names)

    return run


def judge_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of ``docs`` (doc_id, text).

    ``base_failed``: fewer than 20 words, or more than 30 % of them in windows of eight words that the text holds twice. ``kept``: neither that nor
    rejected by any of ``rules``. Null texts are empty and fail. Rows are judged one by one, so repeated rows and ids
    all stay; texts of any length are read whole; other columns are not read. No rows give no rows.
    """
    order = plan_cascade(docs, rules, sample_rows)
    rows = docs.select(F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return rows.mapInArrow(_cascade(order), f"row {dict(rows.dtypes)['row']}, {kind}").withColumnRenamed("row", "doc_id")


def quality_sql(rules: Sequence[Rule] = RULES) -> str:
    """The same rows in DuckDB's SQL; every rule is evaluated."""
    space = "[\\x20\\x09-\\x0D]"
    return f"""
    with d as (
      select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
    f as (
      select r, doc_id, words, len(words)::bigint as n_words, list_sum(list_transform(words, lambda w: length(w)))::bigint as chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(regexp_extract_all(text, '\\p{{Lu}}')) as n_capitals, len(regexp_extract_all(text, '\\p{{L}}')) as n_letters,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as raw from d),
    g as (
      select f.*, coalesce(chars, 0)::bigint as word_chars, (len(raw) - len(list_distinct(raw)))::bigint as n_dup_lines,
             list_transform(raw, lambda x: regexp_replace(x, '^{space}+|{space}+$', '', 'g')) as lines,
             len(list_filter(range(1, n_words), lambda i: words[i] = words[i + 1])) as n_stutters from f),
    w as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from d),
    k as (select r, i, concat_ws(' ', word, {', '.join(f'lead(word, {j}) over o' for j in range(1, WINDOW))}) as win, lead(word, {WINDOW - 1}) over o is not null as full_
          from w window o as (partition by r order by i)),
    two as (select r, win from k where full_ group by r, win having count(*) > 1),
    hit as (select distinct k.r, unnest(range(i, i + {WINDOW})) as word from k join two on two.r = k.r and two.win = k.win where full_),
    n as (select r, count(*) as n from hit group by r),
    b as (
      select g.*, coalesce(n, 0)::bigint as n_repeat_words, n_words < {LEAST_WORDS} or 100 * coalesce(n, 0) > {MOST_REPEATED} * n_words as base_failed
      from g left join n on n.r = g.r)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not ({' or '.join(f'({r.sql})' for r in rules)}) as kept from b
    """
