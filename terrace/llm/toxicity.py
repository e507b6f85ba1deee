"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols (insult, threat, target, negation, report, other) with a weight. Small transducers follow one
condition each: insults, threats that find their target on either side, whether insults have a target, whether a negation is
near, whether the clause reports speech. A transducer scales the weight that a symbol brings, may emit weight of its own when
a pattern is complete, and scales what others emit while it is in a state. ``compose`` makes one transducer of them, whose
state is the tuple of theirs; it runs over each clause and scores the clause's matches, so "you are no idiot" and "she said
idiot" weigh less than "you idiot", and "kill you" more than "kill the process". A document's features are sums over its
matched clauses; a logistic curve makes them a score.

What is learned: words and word beginnings that mark insults, with log-odds weights, and the curve. The learner reads at
most ``MAX_TRAIN`` labelled rows, those with the smallest hashed ids, from rows whose crc32(doc_id) mod 4 is not 2. Tasks
count their words; only counts of words that toxic rows share, and four features a row for the curve, come to the driver, no
text does. Labels, lang, source and doc_id are no inputs of a score. Without enough labelled rows the seed words alone are
the lexicon.

Defined results: null and empty texts have no clause and get the curve's score there; very long texts are read whole;
null labels are skipped, and of several labels of a document the largest counts; of several texts of a labelled doc_id the
least is learned from; repeated rows are scored one by one; empty tables give empty tables; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p, prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lean, stored, table

MAX_TRAIN = 8000
THRESHOLD = 0.3

#: Seed words of the grammar, in four languages.
SEED = {
    "insult": "idiot moron stupid idiote imbécile connard stupide dummkopf arschloch idiota imbécil estúpido",
    "threat": "kill murder hurt destroy töten umbringen tuer tuerai matar mataré",
    "target": "you your yourself he him she her they them du dich dein ihr euch tu toi vous ton te tú usted vosotros",
    "negation": "not no never isn't aren't nicht kein keine nie pas jamais ne nunca tampoco",
    "report": "said says called wrote quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
SEED_WEIGHT = {"insult": 3.0, "threat": 1.0}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = (4, 5, 6, 7)
#: A feature must be this unlikely (twice the log likelihood ratio) to be as frequent in toxic rows by chance.
MIN_LLR = 24.0
#: And so many toxic rows must have it.
LEAST_ROWS = 4


@dataclass(frozen=True)
class Transducer:
    """step: (state, symbol) to (state, factor of the symbol's weight, weight emitted); what it doesn't name keeps the state
    with factor 1 and emits nothing. damp: by which factor a state scales what other transducers emit."""

    start: int
    step: dict
    damp: dict = field(default_factory=dict)

    def move(self, state: int, symbol: str) -> tuple[int, float, float]:
        return self.step.get((state, symbol), (state, 1.0, 0.0))


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
MATCH = ("insult", "threat")
#: Each insult after the first in a clause weighs more.
INSULT = Transducer(0, {(0, "insult"): (1, 1.0, 0.0), (1, "insult"): (1, 1.1, 0.0)})
#: A threat weighs in full with a target before it; without one, in part, and the rest when a target follows.
THREAT = Transducer(0, {(0, "target"): (1, 1.0, 0.0), (0, "threat"): (2, 0.4, 0.0), (2, "threat"): (2, 0.4, 0.0), (2, "target"): (1, 1.0, 0.6 * SEED_WEIGHT["threat"])})
TARGETED = Transducer(0, {(0, "target"): (1, 1.0, 0.0), (1, "insult"): (1, 1.2, 0.0)})
#: After a negation the next three words are in its scope.
NEGATION = Transducer(
    0, {(s, "negation"): (3, 1.0, 0.0) for s in range(4)} | {(s, x): (max(0, s - 1), 0.3 if x in MATCH and s else 1.0, 0.0) for s in range(4) for x in SYMBOLS if x != "negation"}, {1: 0.3, 2: 0.3, 3: 0.3}
)
REPORTED = Transducer(0, {(0, "report"): (1, 1.0, 0.0)} | {(1, x): (1, 0.5, 0.0) for x in MATCH}, {1: 0.5})


def compose(*parts: Transducer) -> Transducer:
    """The product of transducers: they read the same symbols, their factors multiply, and what one emits is scaled by the
    others' states. States are numbered as reached."""
    start = tuple(p.start for p in parts)
    number, todo, step = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        scale = [p.damp.get(s, 1.0) for p, s in zip(parts, state, strict=True)]
        for x in SYMBOLS:
            moves = [p.move(s, x) for p, s in zip(parts, state, strict=True)]
            to = tuple(m[0] for m in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            emitted = sum(m[2] * prod(scale[:k] + scale[k + 1 :]) for k, m in enumerate(moves))
            step[number[state], x] = (number[to], prod(m[1] for m in moves), emitted)
    return Transducer(0, step)


GRAMMAR = compose(INSULT, THREAT, TARGETED, NEGATION, REPORTED)
#: Words that a model remembers the reading of.
MEMO = 50_000


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-3.0, 1.5, 0.5, 0.5)
    symbols: dict[str, str] = field(default_factory=lambda: {w: kind for kind, words in SEED.items() for w in words.split()})
    memo: dict[str, tuple[str, float]] = field(default_factory=dict, repr=False)

    def read(self, word: str) -> tuple[str, float]:
        """Symbol and weight of a lower-case word."""
        found = self.memo.get(word)
        if found is None:
            kind = self.symbols.get(word, "other")
            weight = self.words.get(word, SEED_WEIGHT.get(kind, 0.0))
            if not weight and self.beginnings:
                weight = max((self.beginnings.get(word[:k], 0.0) for k in PREFIXES if len(word) > k), default=0.0)
            found = (kind if kind == "threat" or not weight else "insult", weight)
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The clauses with matches, and their scores."""
        low = text.lower()
        if not any(self.read(w)[1] for w in set(WORD.findall(low))):
            return []
        out = []
        for clause in CLAUSE.split(low):
            state, score = GRAMMAR.start, 0.0
            for w in WORD.findall(clause):
                symbol, weight = self.read(w)
                state, factor, emitted = GRAMMAR.step[state, symbol]
                score += weight * factor + emitted
            if score:
                out.append((clause, score))
        return out

    def features(self, text: str, clauses: list[tuple[str, float]] | None = None) -> list[float]:
        scores = [s for _, s in (self.clauses(text) if clauses is None else clauses)]
        total = sum(scores)
        return [1.0, log1p(total), log1p(max(scores, default=0.0)), log1p(500 * total / (20 + len(text)))]

    def score(self, text: str, clauses: list[tuple[str, float]] | None = None) -> float:
        """clauses: those of the text, if they are known."""
        z = sum(a * b for a, b in zip(self.curve, self.features(text, clauses), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def _llr(k: int, n: int, rate: float) -> float:
    q = k / n
    if q <= rate:
        return 0.0
    return 2 * (k * log(q / rate) + ((n - k) * log((1 - q) / (1 - rate)) if n > k else 0.0))


def weights(counts: Iterable[tuple[str, int, int]], n1: int, n0: int, least_share: float) -> dict[str, float]:
    """Log-odds of the features that mark toxic rows, of (feature, toxic rows, other rows)."""
    return {
        f: log((k + 0.5) / (n1 + 1)) - log((m + 0.5) / (n0 + 1))
        for f, k, m in counts
        if k >= LEAST_ROWS and k >= least_share * (k + m) and _llr(k, k + m, n1 / (n1 + n0)) > MIN_LLR
    }


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a ridge, by Newton's steps."""
    c = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.3] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ c)
    return tuple(float(v) for v in c)


def word_set(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def beginnings(words: set[str], known: Container[str]) -> set[str]:
    """Beginnings of words that are not known themselves."""
    return {w[:k] for w in words if w not in known for k in PREFIXES if len(w) > k}


def _counted(rows: DataFrame, features: Callable[[str], set[str]]) -> list[tuple[str, int, int]]:
    """Features that enough toxic rows have: (feature, toxic rows, other rows). Counted in tasks, then over all."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, mark in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                (pos if mark else neg).update(features(text.as_py()))
            names = sorted(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[f] for f in names], pa.int64()), pa.array([neg[f] for f in names], pa.int64())], names=["feature", "pos", "neg"])

    found = rows.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sorted(tuple(r) for r in found.filter(F.col("pos") >= LEAST_ROWS).collect())


def fit(rows: DataFrame) -> Model:
    """Lexicon from two thirds of labelled rows (id, text, mark: 0 or 1), curve from the rest."""
    model = Model()
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    learn, rest = rows.filter("part < 2"), rows.filter("part = 2").select("text", "mark")
    n = {(r["rest"], r["mark"]): r["n"] for r in rows.groupBy((F.col("part") == 2).alias("rest"), "mark").agg(F.count("*").alias("n")).collect()}
    sizes = [n.get((part, mark), 0) for part in (False, True) for mark in (0, 1)]
    if sum(sizes) < 30 or 0 in sizes:
        return model
    n0, n1 = sizes[:2]
    learn = learn.select("text", "mark")
    model.words = weights(_counted(learn, word_set), n1, n0, 0.8)
    known = frozenset(model.words)
    # beginnings that mark more than the words found so far
    model.beginnings = weights(_counted(learn, lambda text: beginnings(word_set(text), known)), n1, n0, 0.3)
    learned_so_far = model

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [learned_so_far.features(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("mark")], names=["x", "mark"])

    points = sorted((tuple(r["x"]), r["mark"]) for r in rest.mapInArrow(measured, "x array<double>, mark int").collect())
    model.curve = curve(np.array([x for x, _ in points]), np.array([y for _, y in points], float))
    model.memo = {}
    return model


def held_out(key) -> F.Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "toxic", most: int = MAX_TRAIN) -> Model:
    """Fits a model. The rows to learn from are chosen from the labels alone, their at most ``most`` ids are broadcast, and
    their texts are stored for the passes over them."""
    marks = labels.select(F.col(key).cast("long").alias("id"), F.col(mark).cast("int").alias("mark")).filter(F.col("id").isNotNull() & F.col("mark").isNotNull() & ~held_out(F.col("id")))
    chosen = marks.groupBy("id").agg(F.max("mark").alias("mark")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows, path = stored(texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max((F.col("mark") > 0).cast("int")).alias("mark")))
    model = fit(rows)
    forget(docs.sparkSession, path)
    return model


#: Rows of an Arrow batch that are worked on at once.
ROWS = 1000


def _parts(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, held_out, score, predicted, n_clauses (clauses that match)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _parts(batches):
            scores, n = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                clauses = model.clauses(text)
                scores.append(model.score(text, clauses))
                n.append(len(clauses))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], names=["id", "score", "n"])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = plain.mapInArrow(lean(run), "id long, score double, n long")
    return out.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("n").alias("n_clauses"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns; nothing is shuffled."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _parts(batches):
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learned(docs, table(spark, sf_dir, "labels"))).drop("n_clauses")


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
