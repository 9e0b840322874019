"""The shingle join against all pairs."""

import random
import re

import pytest

from siteworks.llm.jaccard_join import keep_one_each, link_documents, size_classes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "X", "é", "zz")]
    texts = [None, "", " \t\n\x0b", "one", "ONE", "one two", "two one", "One  two", "\x1c\x1c", "a b c", "a b\xa0c"]
    for n in (4, 8, 11, 12, 13, 20, 40, 90, 400):
        base = [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(edits if n > 12 else min(edits, 1)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 2)]))
        for start in range(0, n // 2, max(1, n // 30)):  # a chain: each linked with the next only
            texts.append(" ".join((base + base[::-1])[start : start + n]))
    common = " ".join(rng.choice(words) + "q" for _ in range(60))
    texts += [common + " " + " ".join(f"u{rng.random()}" for _ in range(40)) for _ in range(40)]
    texts += [common + " " + " ".join(f"u{rng.random()}" for _ in range(rng.randint(0, 9))) for _ in range(60)]
    base = [f"n{i}" for i in range(148)]
    for _ in range(90):  # copies a few edits apart: only some pairs link
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr("siteworks.llm.jaccard_join.BLOCK", 16)
    texts = corpus(seed)
    rows = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(3)
    got = sorted(tuple(r) for r in link_documents(rows).collect())
    assert got == brute(texts)


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(7, text), (7, text), (9, text + " x"), (None, "alone here now"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in link_documents(rows).collect()), key=str)
    assert got == sorted([(7, 48, 7), (7, 48, 7), (9, 49, 7), (None, 1, None), (3, 0, 3)], key=str)
    assert sorted(str(r.doc_id) for r in keep_one_each(rows).collect()) == ["3", "7", "None"]


def test_empty_table(spark):
    assert link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_classes_meet_every_size():
    bounds = size_classes(90)
    assert bounds[0] == 9 and all(b > a / 0.9 for a, b in zip(bounds, bounds[1:], strict=False))


def brute_at(texts, size, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    root = list(range(len(texts)))
    for i, left in enumerate(sets):
        for j in range(i):
            common = len(left & sets[j])
            if left and root[i] != root[j] and 100 * common >= percent * (len(left) + len(sets[j]) - common):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent"), [(5, 80)])
def test_other_thresholds_equal_all_pairs(spark, size, percent, monkeypatch):
    monkeypatch.setattr("siteworks.llm.jaccard_join.BLOCK", 16)
    texts = corpus(3)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in link_documents(rows, size, percent).collect()) == brute_at(texts, size, percent)


def test_one_row_stays_of_each_group(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a), (5, a + " x"), (5, b), (6, b + " y"), (None, "no id here"), (None, "no id here"), (None, b + " z"), (8, ""), (8, ""), (None, None), (None, None)]
    got = keep_one_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, a), (5, b), (None, "no id here"), (8, ""), (8, ""), (None, None), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
