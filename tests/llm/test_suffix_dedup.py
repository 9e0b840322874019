"""Suffix de-duplication against a plain search for repeated windows."""

import random
from collections import Counter

import pytest

from siteworks.llm.queries import QUERIES
from siteworks.llm.suffix_dedup import difference_cover, drop_passages, remove_repeats, remove_repeats_and_passages

SCHEMA = "doc_id long, text string, source string, kept string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def result(spark, texts, **sizes):
    rows = spark.createDataFrame([(i, t, "s", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = remove_repeats(rows.repartition(3), **sizes).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]


def test_every_difference_is_covered():
    for period in (2, 7, 13, 57):
        cover = difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def mixed_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (9, 14, 40, 90)]
    texts = [None, "", "short", "x" * 300, "ab" * 200, prose(300)]
    for _ in range(60):
        parts = [prose(rng.randint(0, 25)) for _ in range(3)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [texts[8]] * 3 + [texts[9][5:]] + [texts[10][:-7] + "tail"] + [texts[11][:40] + "#" + texts[11][40:]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = mixed_texts(seed)
    assert result(spark, texts, length=40, window=17, period=13) == brute(texts, 40)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_inside_shorter_strings_equals_brute_force(spark, seed):
    """With all runs of strings of 20 bytes as passages, what is left is what the search for 20 bytes leaves."""
    texts = mixed_texts(seed)
    texts += texts[20:23]
    rows = spark.createDataFrame([(min(i, 40), t, "s", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = remove_repeats_and_passages(rows, 40, 17, 13, words=0, passage={"length": 20, "window": 9, "period": 7}).collect()
    seen = lambda r: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), sum(p.end - p.start for p in r.passages), bytes(r.rest))
    want = [(*long, short[1], short[3]) for long, short in zip(brute(texts, 40), brute(texts, 20), strict=True)]
    assert Counter(map(seen, got)) == Counter(want)
    few = remove_repeats_and_passages(rows, 40, 17, 13, words=10**6, passage={"length": 20, "window": 9, "period": 7}).collect()
    assert all(not r.passages and r.rest == r.kept for r in few)


def test_query_tells_passages_of_over_fifty_words(spark, tmp_path):
    """Shorter than 400 bytes: they stay in the contract's columns, and are counted and cut in those that follow. Phrases stay in all."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 6))) for _ in range(n))
    passage, phrase, long = prose(55), prose(30), prose(120)
    assert len(passage) < 400 < len(long)
    texts = [f"{prose(60)} | {part} | {prose(60)}" for part in (passage, passage, phrase, phrase, long, long, prose(55))] + [None, ""]
    path = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, path).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {4, 5}
    assert {i for i, r in got.items() if r.n_passages} == {0, 1, 4, 5} and all(r.n_passages <= 1 for r in got.values())
    for i, r in got.items():
        assert r.n_chars == len(r.text or "") == len(texts[i] or "") - r.n_passage_bytes
        assert i not in (0, 1) or (passage not in r.text and abs(r.n_passage_bytes - len(passage)) <= 12)
        assert r.n_passages or r.text == texts[i]


def test_long_text_is_cut_into_parts_without_loss(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    texts = [long, "start " + long[524_000:526_000] + " end", long[900_000:900_399]]
    got = result(spark, texts)
    assert [(g[0], g[1], g[2]) for g in got] == [(1_300_000, 2000, 1), (2010, 2000, 1), (399, 0, 0)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_passages_of_over_fifty_words_go_and_phrases_stay(spark):
    """51 short words are far below 400 bytes; 40 long ones are no passage, though they are above the bytes searched for."""
    rng = random.Random(8)
    prose = lambda n, size=5: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, size))) for _ in range(n))
    passage, phrase = prose(51), prose(40, 9)
    assert len(passage) < 400 and 204 < len(phrase) < 400
    texts = [f"{prose(30)} {part} {prose(30)}" for part in (passage, passage, phrase, phrase, prose(80))] + [f"{passage} {prose(9)}", None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = [r.text for r in drop_passages(docs.repartition(3)).orderBy("doc_id").collect()]
    assert got[2:5] == texts[2:5] and got[6:] == [None, ""]
    for i in (0, 1, 5):
        before, after = texts[i].split(passage)
        # A letter or blank beside the passage may be the same in two texts by chance, and goes with it.
        assert got[i].startswith(before[:-4]) and got[i].endswith(after[4:]) and len(before + after) - 8 <= len(got[i]) <= len(before + after)
