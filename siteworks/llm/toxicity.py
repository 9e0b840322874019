"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech or other. Small
transducers read them, each with a weight on its arcs: an insult weighs more shortly after
a target, less after a negation, less in reported speech; a threat weighs only if a
target follows. Their composition is one table, and a clause's weight is what that table
gives out along it, so a word alone decides nothing.

The insult arcs (words and word beginnings) and their weights are learned from labelled
documents: those that toxic documents use far more often than others, by more than chance
explains. A logistic curve, fitted on the same documents, turns the total, the strongest
clause and the density into a score. Targets, negations, threats and reports are given lists.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.llm.common import free_name, slices, store

#: Labelled documents that are learned from, at most about: chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Insult arcs at most, the strongest first: bounds the model whatever the data.
ARCS = 4096
STEMS = (4, 5, 6)
LEAST_DOCS = 3
LEAST_ODDS = 10.0
#: Log-likelihood ratio below which a difference may be chance, many words being tried.
LEAST_EVIDENCE = 25.0
LONGEST_WORD = 30
THRESHOLD = 0.7

TARGETS = frozenset("you your yours yourself u ya du dich dir ihr euch tu toi te vous ti usted ustedes vosotros vos".split())
NEGATIONS = frozenset("not no never neither nor without isn aren wasn don doesn didn nicht kein keine keinen nie pas jamais aucun nunca jamás tampoco ni".split())
REPORTS = frozenset(
    "said says say told called calls wrote writes claimed quoted quote according allegedly sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
)
THREATS = frozenset("kill hurt shoot stab strangle murder punch beat destroy töte töten tuer tue frapper matar mataré golpear".split())
THREAT_WEIGHT = 3.0

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?;\n]")

Arcs = dict[tuple[int, int], tuple[int, float]]


class Transducer:
    """States 0..n-1, a start at 0, and for every state and symbol a next state and a factor."""

    def __init__(self, states: int, step: Callable[[int, int], tuple[int, float]]):
        self.arcs: Arcs = {(q, s): step(q, s) for q in range(states) for s in range(6)}

    @classmethod
    def of(cls, arcs: Arcs) -> Transducer:
        made = cls(0, lambda q, s: (q, 1.0))
        made.arcs = arcs
        return made


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both read the same symbols; their factors multiply. States are those that can be reached."""
    number = {(0, 0): 0}
    arcs: Arcs = {}
    todo = [(0, 0)]
    while todo:
        a, b = pair = todo.pop()
        for s in range(6):
            (na, fa), (nb, fb) = first.arcs[a, s], second.arcs[b, s]
            if (na, nb) not in number:
                number[na, nb] = len(number)
                todo.append((na, nb))
            arcs[number[pair], s] = number[na, nb], fa * fb
    return Transducer.of(arcs)


def _within(opener: int, weighs: int, near: float, far: float, words: int = 3) -> Transducer:
    """``weighs`` has the factor ``near`` up to ``words`` words after ``opener``, else ``far``."""
    return Transducer(words + 1, lambda q, s: (words if s == opener else max(0, q - 1), (near if q else far) if s == weighs else 1.0))


def grammar() -> Transducer:
    insulted = _within(TARGET, INSULT, 1.5, 1.0)
    threatened = _within(THREAT, TARGET, 1.0, 0.0)
    negated = compose(_within(NEGATION, INSULT, 0.25, 1.0), _within(NEGATION, TARGET, 0.25, 1.0, words=5))
    reported = Transducer(2, lambda q, s: (1 if s == REPORT else q, 0.5 if q and s in (INSULT, TARGET) else 1.0))
    made = insulted
    for part in (threatened, negated, reported):
        made = compose(made, part)
    return made


class Scorer:
    """Weighs the clauses of texts. ``lexicon`` has the weight of words (``=word``) and of word beginnings (``begin*``)."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {k[1:]: w for k, w in lexicon.items() if k[0] == "="}
        self.stems = {k[:-1]: w for k, w in lexicon.items() if k[0] != "="}
        self.lengths = sorted({len(s) for s in self.stems})
        arcs = grammar().arcs
        self.table = [[arcs[q, s] for s in range(6)] for q in range(len(arcs) // 6)]
        self.find = ahocorasick.Automaton()
        for key in {*self.words, *self.stems, *THREATS}:
            self.find.add_word(key, len(key))
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        if weight:
            return INSULT, weight
        if word in TARGETS:
            return TARGET, THREAT_WEIGHT
        return (THREAT if word in THREATS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER), 0.0

    def clause(self, words: Iterable[str]) -> float:
        state, total = 0, 0.0
        for word in words:
            kind, weight = self.symbol(word)
            state, factor = self.table[state][kind]
            total += weight * factor
        return total

    def __call__(self, text: str) -> tuple[float, float, float]:
        """Total weight, strongest clause and density; clauses without an insult or threat are not read."""
        text = text.lower()
        total = most = 0.0
        end_of = -1
        for last, size in self.find.iter(text):
            start = last - size + 1
            if last < end_of or start and text[start - 1].isalpha():
                continue
            begin = max(text.rfind(c, max(0, end_of), start) for c in ".!?;\n") + 1
            begin = max(begin, end_of, 0)
            stop = _STOP.search(text, last)
            end_of = stop.end() if stop else len(text)
            weight = self.clause(_WORD.findall(text, begin, end_of))
            total += weight
            most = max(most, weight)
        return math.log1p(total), most, math.log1p(1000 * total / (len(text) + 200))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and word beginning: documents and uses, by label."""
    names = ["arc", "toxic_docs", "clean_docs", "toxic_uses", "clean_uses"]

    def flush(held: list[Counter]) -> pa.RecordBatch:
        arcs = list(set(held[0]) | set(held[1]))
        columns = [pa.array(arcs, pa.string()), *[pa.array([h[a] for a in arcs], pa.int64()) for h in held]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    held = [Counter() for _ in range(4)]
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uses: Counter = Counter()
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                if len(word) <= LONGEST_WORD:
                    uses[f"={word}"] += n
                for k in STEMS:
                    if len(word) >= k:
                        uses[f"{word[:k]}*"] += n
            label = 0 if toxic else 1
            held[label].update(uses.keys())
            held[label + 2].update(uses)
            if len(held[0]) + len(held[1]) > 300_000:
                yield flush(held)
                held = [Counter() for _ in range(4)]
    yield flush(held)


def _part(used, total):
    """One term of the log-likelihood ratio; 0 where nothing was seen."""
    return lambda share: F.when(used > 0, used * F.log(used / (total * share))).otherwise(0.0)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Insult arcs and weights from ``sample`` (text, toxic)."""
    size = sample.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    if not size["t"] or not size["c"]:
        return {}
    counts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(
        _count, "arc string, toxic_docs long, clean_docs long, toxic_uses long, clean_uses long"
    )
    summed = counts.groupBy("arc").agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).where(F.col("toxic_docs") >= LEAST_DOCS)
    t, c = F.lit(float(size["t"])), F.lit(float(size["c"]))
    a, b = F.col("toxic_docs").cast("double"), F.col("clean_docs").cast("double")
    share = (a + b) / (t + c)
    ratio = 2 * (_part(a, t)(share) + _part(b, c)(share) + _part(t - a, t)(1 - share) + _part(c - b, c)(1 - share))
    odds = (F.col("toxic_uses") + 0.5) / (t + 1) / ((F.col("clean_uses") + 0.5) / (c + 1))
    kept = summed.select("arc", ratio.alias("evidence"), odds.alias("odds")).where((F.col("odds") >= LEAST_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
    best = kept.orderBy(F.col("evidence").desc(), "arc").limit(ARCS).collect()
    return {r["arc"]: min(5.0, math.log(r["odds"])) for r in best}


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's steps; the first number is the constant."""
    x = np.column_stack([np.ones(len(features)), features]) if len(features) else np.zeros((0, 4))
    w = np.zeros(4)
    if not len(x) or labels.min() == labels.max():
        return [float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))), 0.0, 0.0, 0.0]
    keep = ridge * np.diag([1e-3, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (labels - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _features(lexicon: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches):
            made = [scorer(t or "") for t in batch.column(0).to_pylist()]
            columns = [pa.array([m[k] for m in made], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["total", "most", "density", "toxic"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Lexicon and curve from the documents that ``labels`` (doc_id, toxic) covers, held-out ones left out."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = TRAIN_ROWS / max(TRAIN_ROWS, known.count())
    # About TRAIN_ROWS small rows: safe to broadcast at any scale.
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = store(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    lexicon = learn_lexicon(sample)
    rows = sample.mapInArrow(_features(lexicon), "total double, most double, density double, toxic int").collect()
    features = np.array([[r["total"], r["most"], r["density"]] for r in rows]).reshape(-1, 3)
    return lexicon, fit_curve(features, np.array([r["toxic"] for r in rows], dtype=float))


def _score(lexicon: dict[str, float], curve: list[float], column: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches):
            scores = []
            for text in batch.column(column).to_pylist():
                z = curve[0] + sum(w * f for w, f in zip(curve[1:], scorer(text or ""), strict=True))
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """``docs`` (doc_id, text, ...) with a score, 0 to 1, in the column ``name``; a column of that name is replaced.

    Null and empty texts score as a text without any matched clause. With no labelled document, or only one
    label, the score is the label's share. Rows that stand twice score alike; a null doc_id is scored too.
    """
    lexicon, curve = train(docs, labels)
    docs = docs.drop(name)
    schema = ", ".join(f"`{column}` {kind}" for column, kind in [*docs.dtypes, (name, "double")])
    return docs.mapInArrow(_score(lexicon, curve, docs.columns.index("text"), name), schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names; see ``score_documents``."""
    score = free_name(docs, "toxicity")
    return score_documents(docs, labels, score).where(F.col(score) < threshold).select(*docs.columns)
