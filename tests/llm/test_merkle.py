"""The manifest against a plain recursive one; the layout's arithmetic; odd tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siteworks.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    out = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[name]
        if name == "text" and lower and v is not None:
            v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return digest(*out)


def tree(nodes, fan):
    """Root, and for every leaf the list of (before, after) in its runs."""
    paths, of = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for at in range(0, len(nodes), fan):
            run = nodes[at : at + fan]
            for k, _ in enumerate(run):
                for i in of[at + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            up.append(digest(*run))
            owners.append([i for o in of[at : at + fan] for i in o])
        nodes, of = up, owners
    return nodes[0], paths


def brute(rows, fan=16):
    tampered = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in sources}
    built = {s: tree([leaf(r) for r in groups[s]], fan) for s in sources}
    root, tops = tree([built[s][0] for s in sources], fan)
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(groups[s], built[s][1], strict=True):
            x = leaf(r, lower=tampered(r))
            for before, after in path + top:
                x = digest(*before, x, *after)
            proof = digest(*[d for before, after in path + top for d in before + after])
            out.append((r["doc_id"], leaf(r), built[s][0], root, proof, x, x == root))
    return sorted(out, key=str)


def proofs(docs, **options):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest_proofs(docs, received=merkle.lower_ascii(F.col("text")), tampered=changed, **options)
    return sorted((tuple(r) for r in made.collect()), key=str)


def as_rows(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


@pytest.mark.parametrize("fan", [2, 3, 16])
@pytest.mark.parametrize("height", [1, 2, 3, 4, 5])
def test_addresses_fill_the_layout(fan, height):
    if fan == 16 and height > 3:
        return
    seen = [merkle.address(height, d, i, fan) for d in range(height) for i in range(fan**d)]
    assert sorted(seen) == list(range(merkle.subtree_size(height, fan)))
    top = height // 2
    if top:
        assert sorted(merkle.address(height, d, i, fan) for d in range(top) for i in range(fan**d)) == list(range(merkle.subtree_size(top, fan)))


@pytest.mark.parametrize("levels,fan", [(3, 16), (1, 16), (2, 3), (1, 2)])
def test_equals_brute_force(spark, levels, fan):
    rows = [(i * 7 % 211, f"Text {i} É", "en", f"s{i % 5}" if i % 3 else "hot", i) for i in range(211)]
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (None, "No id", "fr", "hot", 3), (None, None, "fr", "hot", 3)]
    rows += [(5, "Same id", "en", "hot", 7), (5, "same id", "en", "hot", 7), (9, "Twice", "en", "lone", 5), (9, "Twice", "en", "lone", 5), (2000, "Lone", "de", "é", 4)]
    rows += [(3000, "Long " * 300_000, "en", "hot", 1)]
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    assert proofs(docs, levels=levels, fan=fan) == brute(as_rows(rows), fan)


def test_one_row_and_none(spark):
    one = [(5, "Aa", "en", "s", 2)]
    assert proofs(spark.createDataFrame(one, KIND)) == brute(as_rows(one))
    assert proofs(spark.createDataFrame([], KIND)) == []


def test_extra_columns_do_not_matter(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 2}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, KIND)
    extra = docs
    for name in ("group", "digest", "received", "position", "total", "block", "path", "root", "leaf", "uid", "mark", "part", "name"):
        extra = extra.withColumn(name, F.lit("x"))
    assert proofs(extra) == proofs(docs)


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "Word", "en", "s", 4) for i in range(100)], KIND)
    made = merkle.manifest_proofs(docs, received=F.lit("word"), tampered=F.col("doc_id") == 42).collect()
    assert {r.doc_id for r in made if not r.verified} == {42} and len({r.root for r in made}) == 1
