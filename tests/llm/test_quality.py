"""The cascade against plain counts and rules; the order of rules; odd tables; labelled junk."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siteworks.llm import quality
from siteworks.llm.common import ByteHash

SF = "/root/testdata/sf0.01"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    repeated = len({j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})
    failed = n < 20 or 100 * repeated > 30 * n
    stripped = [x.strip(" \t\n\r\x0b\x0c") for x in lines]
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    bad = (
        10 * symbols > n
        or not 3 * n <= chars <= 10 * n
        or 5 * dup > 2 * len(lines)
        or 10 * sum(any(c.isalpha() for c in w) for w in words) < 8 * n
        or 5 * upper > 2 * chars
        or (5 * upper > chars and 5 * upper > 2 * letters)
        or 10 * sum(a == b for a, b in zip(words, words[1:])) > n
        or len(set(words)) ** 2 < n
        or 10 * sum(x.endswith(("...", "…")) for x in stripped) > 3 * len(lines)
        or 10 * sum(x.startswith(("•", "‣", "-", "*")) for x in stripped) > 9 * len(lines)
    )
    return n, chars, symbols, dup, repeated, failed, not failed and not bad


def texts():
    rng = random.Random(8)
    prose = lambda n, k=400: " ".join(f"wo{chr(97 + rng.randrange(26))}{rng.choice('éabcß')}{rng.randrange(k)}" for _ in range(n))
    alpha = lambda n: " ".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = alpha(12)
    out = [None, "", " \n\t ", "one", alpha(19), alpha(20), prose(40), alpha(200), "\n".join([passage] * 3), passage + " x " + passage + " " + alpha(100)]
    out += [alpha(30) + "\n" + "# $ % " * 5, "\n".join(alpha(4) + "..." for _ in range(10)), "\n".join("- " + alpha(4) for _ in range(10)), alpha(40).upper(), "ha " * 50 + alpha(90)]
    out += ["word " * 500 + alpha(30), "\n".join([alpha(5), ""] * 9 + ["same line here"] * 8), "1 2 3 4 5 6 7 8 9 0 " * 2 + alpha(30), alpha(25) + " " + "x" * 400, "a b c d e f g h i j " + "k l m n o p q r s t u"]
    out += ["   " + alpha(30), "\x0b\x0c" + alpha(22), "日本語 " * 3 + alpha(30), alpha(60_000), (alpha(30_000) + "\n") * 2, "x" * 1_500_000, alpha(10) + "\r\n" + alpha(10) + "\r\n" + alpha(10)]
    out += [prose(rng.randint(15, 60), 3) + "\n" + alpha(rng.randint(0, 80)) for _ in range(120)]
    return out


def test_equals_plain_rules(spark):
    made = texts()
    rows = [(i, t) for i, t in enumerate(made)] + [(None, made[7]), (7, made[7]), (7, made[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("row", "kept", "n_words", "mask", "n", "spent"):
        docs = docs.withColumn(name, F.lit("x"))
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in quality.judge_documents(docs).collect())
    assert got == Counter((i, *plain(t)) for i, t in rows)
    assert {k[-1] for k in got} == {True, False}


def test_parts_of_a_text_count_as_one(monkeypatch):
    hasher, made = ByteHash(7), [(t or "").encode() for t in texts()[:22]]
    whole = quality.base_counts(made, hasher)
    monkeypatch.setattr(quality, "PART_BYTES", 50)
    parts = quality.base_counts(made, hasher)
    assert all((whole[c] == parts[c]).all() for c in whole)


def test_empty_table(spark):
    assert quality.judge_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_order_of_rules():
    # The second repeats the first at ten times its cost; the third rejects others, rarely.
    assert quality.by_rejection_per_cost([1.0, 10.0, 1.0], {0b011: 50, 0b100: 5, 0: 100}) == [0, 2, 1]
    assert quality.by_rejection_per_cost([1.0, 1.0], {0b01: 1, 0b10: 9}) == [1, 0]
    assert quality.by_rejection_per_cost([3.0, 1.0, 2.0], {}) == [1, 2, 0]


def test_verdict_does_not_depend_on_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = (sorted(map(tuple, quality.judge_documents(docs, rules, sample).collect())) for rules, sample in ((quality.RULES, 4000), (quality.RULES[::-1], 20)))
    assert one == other


def test_costs_are_of_the_sample(spark):
    slow = quality.Rule("slow", lambda t: sum(1 for _ in range(20_000)) < 0, "false")
    junk = quality.Rule("junk", lambda t: t.n_symbols > 0, "n_symbols > 0")
    docs = spark.createDataFrame([(i, "word number " * 3 + " ".join(f"w{i}x{k}" for k in range(30)) + (" #" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    assert [r.name for r in quality.plan_cascade(docs, [slow, junk])] == ["junk", "slow"]


@pytest.mark.parametrize("label,share", [(1, 0.97), (0, 0.03)])
def test_labelled_documents(spark, label, share):
    """Of documents labelled good nearly all of 20 words or more stay; of those labelled bad nearly none."""
    kept = quality.judge_documents(spark.read.parquet(f"{SF}/documents.parquet")).where("n_words >= 20")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.col("quality") == label)
    got = kept.join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert got >= share if label else got <= share
