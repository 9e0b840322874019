"""Packing: whole results, the reduction against exhaustive search, and the tokenizer's own ids."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from siteworks.llm.packing import WordIds, build_sequences, pack_documents, plan_bins, tokenizer_path


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                left = list(bins)
                left.remove(room)
                go(i + 1, [*left, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def contents(ranges, counts, capacity):
    bins, ranks = defaultdict(list), Counter()
    for size, lo, n, each, first, at in ranges:
        assert lo == ranks[size]
        ranks[size] += n
        for y in range(n):
            bins[first + y // each].append((at + y % each * size, size))
    assert ranks == Counter(counts)
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_small_instances(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 30) if seed % 2 else rng.randint(8, 30) for _ in range(10)]
    ranges, bins = plan_bins(Counter(items), 30)
    assert len(contents(ranges, Counter(items), 30)) == bins
    assert bins <= optimum(items, 30) + 1


def test_large_counts_stay_small_and_tight():
    rng = random.Random(1)
    counts = {s: rng.randint(1, 50_000) for s in rng.sample(range(1, 4097), 3000)}
    ranges, bins = plan_bins(counts, 4096)
    total = sum(s * n for s, n in counts.items())
    assert len(ranges) < 30_000 and bins <= total / 4096 * 1.02 + 1
    assert sum(r[2] for r in ranges) == sum(counts.values())


def texts():
    rng = random.Random(3)
    words = ["Straße", "ΣΑΣ", "İi", "don't", "x²", "½", "a\x1cb", "<|endoftext|>", "né", "é", "42", "\x85", "a\xa0b", "​", "汉字"]
    made = [" ".join(rng.choice(words) + rng.choice(["", "!", "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    return [None, "", " \t", *made, " ".join(str(rng.random()) for _ in range(1500)), made[5], made[5]]


def test_word_ids_equal_whole_text_ids():
    own = WordIds(tokenizer_path())
    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    data = texts()
    for t, ids in zip(data, own([t or "" for t in data]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_documents_come_back(spark):
    data = texts()
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(data)] + [(None, "no id", 5), (0, None, 5)], "doc_id long, text string, length int")
    got = pack_documents(rows.repartition(3)).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    sequences = {r.sequence_id: r.ids for r in build_sequences(rows.repartition(2)).collect()}
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == len(placed)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    for i, t in enumerate(data):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)[: -(-len(ids) // 4096)]
        assert [(r.start, r.length) for r in mine] == [(a, len(ids[a : a + 4096])) for a in range(0, len(ids), 4096)]
        for r in mine:
            assert r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert pack_documents(rows.limit(0)).collect() == []
