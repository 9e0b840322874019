"""Groups of spelling variants by a permuterm index.

*Words.* Runs of letters are counted per task and summed; only distinct words go on.

*Rotations.* A word gets a terminator and is turned to every place: ``ab`` gives ``ab$``, ``b$a`` and ``$ab``. A
replacement or an inserted code point at a place is then the last character of one rotation,
so a word's neighbours at that place are the rotations in a prefix range that skips the
edited character. Rotations are sorted by that prefix, and one scan reads each range: at most one
word that is the prefix itself, and one word per letter that may follow it, about ninety.

*Neighbours.* Two words that differ by a replacement share one range. A letter inserted in a run of equal
letters could stand at any place of the run; only the first counts. So each pair meets once. A range
emits, for each of its words, how many others it holds and the most frequent of them: two
leaders are enough for that, no pair is written.

*Roots.* Forms are at least ``factor`` times as frequent, so chains are short; each round doubles the step.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.llm.common import crc32_sql, discard, store, store_counted

#: UTF-8 of A-Z, a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"[A-Za-z]+(?:(?:\xc3[\x80-\xbf])+[A-Za-z]*)*|(?:(?:\xc3[\x80-\xbf])+[A-Za-z]*)+")
#: A byte that is in no run, whatever stands around it.
OUTSIDE = re.compile(rb"[^A-Za-z\x80-\xff]")
TERMINATOR = "$"
LEAST_CHARS = 6
LEAST_COUNT = 5
FACTOR = 5
#: One run in about so many loses a code point.
ERROR_EVERY = 199
#: Bytes of a text that are split into runs at once.
PIECE_BYTES = 1 << 20
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 100_000


def _pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that no run spans."""
    at = 0
    while len(text) - at > limit:
        end = OUTSIDE.search(text, at + limit)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def _changed(run: bytes, doc: bytes, every: int) -> bytes:
    """The run, or what a simulated slip leaves of it."""
    h = zlib.crc32(run, zlib.crc32(doc + b":"))
    if h % every:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def _count(least: int, every: int | None):
    """(doc_id, text) into (word, n), summed as far as a task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [(w.decode(), n) for w, n in held.items()]
            held.clear()
            words = [(w, n) for w, n in words if len(w) >= least]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if not text:
                    continue
                doc = (batch.column(0)[k].as_py() or "").encode()
                for piece in _pieces(text):
                    for run, n in Counter(RUN.findall(piece.lower())).items():  # bytes: only A-Z change
                        if len(run) >= least:
                            held[_changed(run, doc, every) if every else run] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    return run


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, error_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of all texts of ``docs`` (doc_id, text), A-Z in lower case, of ``least_chars`` code points or more.

    With ``error_every``, a run in a document loses a code point where that divides the CRC-32 of ``<doc_id>:<run>``;
    a null id is empty there. Null and empty texts have no words.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count(least_chars, error_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """Prefixes that a word's rotations are sorted by, whether a character is skipped, and whether that may be an inserted one."""
    for at in range(len(word) + 1):
        yield word[at:] + TERMINATOR + word[:at], False, True
    for at, skipped in enumerate(word):
        yield word[at + 1 :] + TERMINATOR + word[:at], True, at == 0 or word[at - 1] != skipped


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                rows += [(prefix, skips, inserted, word, n) for prefix, skips, inserted in rotations(word)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["prefix", "skips", "inserted", "word", "n"])


def neighbours_in_range(members: list[tuple[bool, bool, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, others, their largest n, that word) for the rotations (skips, inserted, word, n) of one prefix range."""
    whole = next(((w, n) for skips, _, w, n in members if not skips), None)
    edited = sorted(((-n, w, inserted) for skips, inserted, w, n in members if skips))
    if whole:
        grown = [(m, w) for m, w, inserted in edited if inserted]
        if grown:
            yield whole[0], len(grown), -grown[0][0], grown[0][1]
    for m, w, inserted in edited:
        other = next(((m2, w2) for m2, w2, _ in edited[:2] if w2 != w), None)
        near = len(edited) - 1
        if whole and inserted:
            near += 1
            other = min(x for x in (other, (-whole[1], whole[0])) if x)
        if other:
            yield w, near, -other[0], other[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations into the neighbours of every prefix range; a range may go on over batches."""
    prefix, members = None, []

    def made(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "near", "near_n", "near_word"])

    for batch in batches:
        out = []
        for key, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != prefix:
                if len(members) > 1:
                    out += neighbours_in_range(members)
                prefix, members = key, []
            members.append(member)
        yield made(out)
    yield made(list(neighbours_in_range(members)) if len(members) > 1 else [])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for words (word, n), all distinct, with any near word, their number and the struct (minus n, word) of the most frequent."""
    turned = words.select("word", "n").mapInArrow(_rotate, "prefix string, skips boolean, inserted boolean, word string, n long")
    sorted_ = turned.repartition("prefix").sortWithinPartitions("prefix", "skips")
    found = sorted_.mapInArrow(_scan, "word string, near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near_word").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last; each round doubles how far."""
    roots = store(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root <> next")
        stepped = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after, seen = store_counted(stepped, "spelling-roots", moved=F.count_if("moved"))
        discard(roots)
        roots = after.select("word", "root")
        if not seen["moved"]:
            return roots


def group_words(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced code point. A word's ``form`` is its near word with the largest n (the smallest
    in code-point order among equals) if that is at least ``factor`` times its own, which must be above 1; ``root`` is the last that forms lead to.
    Rows that repeat a word are summed; null words go. No rows give no rows.
    """
    whole = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    kept = store(whole, "spelling-words")
    near = neighbours(kept)
    taken = -F.col("best.minus") >= factor * F.col("n")
    formed = kept.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"),
    )
    formed = store(formed, "spelling-forms")
    discard(kept)
    return formed.join(_roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, error_every: int | None = ERROR_EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """The same for the words of ``docs`` (doc_id, text) that occur ``least_count`` times or more; other columns are not read.

    Texts of any length are split in parts; repeated rows count each; null texts have no words. See ``count_words`` and ``group_words``.
    """
    return group_words(count_words(docs, least_chars, error_every).where(F.col("n") >= least_count), factor)


def groups_sql(error_every: int = ERROR_EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> str:
    """The same rows in DuckDB's SQL: near words share what is left when the character at one place goes, or are what is left."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return f"""
    with recursive runs as (
      select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{upper}', '{upper.lower()}') as run from documents),
    per as (select doc_id, run, count(*) as n from runs where length(run) >= {least_chars} group by all),
    hashed as (select run, n, {crc32_sql("(coalesce(doc_id::varchar, '') || ':' || run)")} as h from per),
    slipped as (
      select case when h % {error_every} = 0
                  then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
    words as (select word, sum(n)::bigint as n from slipped where length(word) >= {least_chars} group by word having sum(n) >= {least_count}),
    cuts as (
      select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest
      from (select word, n, unnest(range(1, length(word) + 1)) as p from words)),
    pairs as (
      select a.word, b.word as other, b.n as m from cuts a join cuts b on a.p = b.p and a.rest = b.rest and a.word <> b.word
      union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
      union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
    best as (select word, count(*) as n_near, max(m) as m from pairs group by word),
    named as (select p.word, n_near, best.m, min(other) as other from pairs p join best on p.word = best.word and p.m = best.m group by all),
    forms as (
      select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= {factor} * w.n then other end as form, case when m >= {factor} * w.n then m end as form_n
      from words w left join named on named.word = w.word),
    steps as (
      select word, word as root, 0 as k from forms
      union all select s.word, f.form, k + 1 from steps s join forms f on f.word = s.root where f.form is not null)
    select word, form, (select arg_max(root, k) from steps s where s.word = f.word) as root, n, n_near, form_n from forms f
    """
