"""The grammar on single clauses, and held-out accuracy on the given labels."""

import random

from siteworks.llm.toxicity import Scorer, compose, fit_curve, grammar, held_out, keep_clean, score_documents, Transducer
import numpy as np

LEXICON = {"=idiot": 4.0, "scum*": 4.0}


def weight(text):
    return Scorer(LEXICON)(text)[1]


def test_clauses():
    assert weight("an idiot was here") == 4 and weight("you idiot") == 6 and weight("scumbags") == 4
    assert weight("not an idiot") == 1 and weight("he said that idiot left") == 2
    assert weight("we will kill you") == 3 and weight("kill time. you there") == 0 and weight("they never kill you") < 1
    assert weight("idiotic ascum") == 0 and weight("") == 0 and weight("He said. An IDIOT!") == 4
    total, most, _ = Scorer(LEXICON)("idiot. you scum, you; fine\nidiot idiot")
    assert most == 8 and abs(np.expm1(total) - (4 + 6 + 8)) < 1e-9


def test_composition_multiplies():
    a = Transducer(2, lambda q, s: (1 - q, 2.0 if s == q else 1.0))
    b = Transducer(3, lambda q, s: ((q + s) % 3, 1.0 + q))
    c = compose(a, b)
    rng = random.Random(1)
    qa = qb = qc = 0
    for _ in range(200):
        s = rng.randrange(6)
        (qa, fa), (qb, fb), (qc, fc) = a.arcs[qa, s], b.arcs[qb, s], c.arcs[qc, s]
        assert fc == fa * fb
    assert len(grammar().arcs) % 6 == 0


def test_curve_separates():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    x = rng.random((400, 3)) + y[:, None] * 2
    w = fit_curve(x, y)
    assert ((np.column_stack([np.ones(400), x]) @ w > 0) == (y > 0)).mean() > 0.98


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, labels).select("doc_id", "toxicity").join(labels, "doc_id").where(held_out())
    rows = [(r.toxicity, r.toxic) for r in scored.select("toxicity", "toxic").collect()]
    toxic, clean = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert len(toxic) > 50
    assert sum(s >= 0.7 for s in toxic) >= 0.9 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)


def test_odd_tables(spark):
    schema = "doc_id long, text string, toxicity string"
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "a" * 100_000, "x"), (2, "a" * 100_000, "x")], schema)
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        got = score_documents(docs, given).collect()
        assert len(got) == 4 and all(0 <= r.toxicity <= 1 for r in got)
    assert keep_clean(docs.limit(0), labels).collect() == []
    assert keep_clean(docs, labels.limit(0)).columns == docs.columns
