"""Spelling groups against a plain comparison of words; prefix ranges; odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siteworks.llm import spelling

KIND = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def edits_of_one(words):
    """Near words of each: those that are equal without one place, or that one place less makes of it."""
    near, rest = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest[i, w[:i] + w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for same in rest.values():
        for w in same:
            near[w] |= same - {w}
    return near


def grouped(words, factor=5):
    near = edits_of_one(words)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] is not None else None) for w in words}


def counted(docs, every=199, least_chars=6, least_count=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_count}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_words_of_few_letters(spark):
    """Every word of up to five letters out of two, and some of three: runs of equal letters in all places."""
    rng = random.Random(4)
    words = {"".join("ab"[k >> i & 1] for i in range(n)): rng.randint(1, 400) for n in range(1, 6) for k in range(2**n)}
    words |= {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.randint(1, 50) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert result(spelling.group_words(df, factor=2)) == grouped(words, 2)
    assert result(spelling.group_words(df, factor=5)) == grouped(words, 5)


def test_documents(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("aeinrstlé×") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    slip = lambda w: w if rng.random() < 0.8 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", "É", w[k] * 2]) + w[k + 1 :]
    docs = [(i, " ".join(slip(rng.choice(stems)).capitalize() + rng.choice([",", "", "1", "Ā"]) for _ in range(200))) for i in range(60)]
    docs += [(7, docs[7][1]), (None, "Lettres lettres LETTRES lettres lettres"), (None, None), (100, ""), (101, "a" * 3_000_000), (102, "Abcdefg " * 200_000), (103, "中文" * 100)]
    df = spark.createDataFrame(docs, KIND)
    extra = df
    for name in ("word", "n", "form", "root", "prefix", "near", "best"):
        extra = extra.withColumn(name, F.lit("x"))
    for every in (199, 7):
        assert result(spelling.spelling_groups(extra, error_every=every)) == grouped(counted(docs, every))


def test_pieces_split_no_run():
    text = ("été word-andmore中x " * 50).encode()
    for limit in (1, 7, 64):
        assert [m for p in spelling._pieces(text, limit) for m in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_empty_repeated_and_null_words(spark):
    assert result(spelling.spelling_groups(spark.createDataFrame([], KIND))) == {}
    df = spark.createDataFrame([("letter", 3), ("letter", 4), (None, 9), ("leter", 1), ("lettre", 7)], "word string, n long")
    assert result(spelling.group_words(df)) == {"letter": (None, "letter", 7, 1, None), "leter": ("letter", "letter", 1, 1, 7), "lettre": (None, "lettre", 7, 0, None)}


def test_forms_lead_on(spark):
    words = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125}
    got = result(spelling.group_words(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and {v[1] for v in got.values()} == {"abbbbb"}
