"""Toxicity by a weighted finite-state pattern grammar (operator 5).

Five word transducers read a text: insults, threats, targets, negations and words of
reported speech.  Insults are accepted whole or by their stem, each with a weight, the log
odds of the form in toxic against other labelled texts.  The clause transducer composes
them: it walks through a clause, remembers targets, recent negations and reported speech,
and emits a clause's weight under the pattern it matched (plain, at a target, negated,
reported, or a threat at a target).  A logistic model of a text's pattern weights is the
score; single words count only through the clauses they complete.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import stored

# Labelled rows that are learned from, at most: those of the least hashes of their ids.
MAX_TRAIN = 20_000
# Forms in the insult lexicon, at most, and what a form must show to be one.
MAX_FORMS = 4_000
MIN_TOXIC = 4
MIN_ODDS = 2.0
STEMS = (4, 5, 6)
FOLDS = 5

# Function words of the four languages the texts are written in.
TARGET = "you your yours he she they him her them du dich dir ihr euch sie tu te toi vous ton il elle usted ustedes ellos ella".split()
NEGATION = "not no never neither nor without isn't aren't don't nicht kein keine nie ohne ne pas jamais sans nunca jamás sin tampoco".split()
REPORTED = "said says say told claims quoted wrote reportedly sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split()
THREAT = "kill hurt destroy beat burn attack töten verletzen zerstören schlagen tuer frapper détruire brûler matar golpear destruir quemar".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"“”«»„]")
_QUOTES = frozenset('"“”«»„')
_ENDS = frozenset(".!?;\n")
_RECENT = 3
PATTERNS = ("plain", "target", "negated", "reported", "threat", "clauses", "strongest")


def forms(word: str) -> list[str]:
    """The forms by which a word is accepted: itself and its stems."""
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


class Grammar:
    """The word transducers, composed with the clause transducer."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.symbols: dict[str, tuple[str, float]] = {}
        self.known = {w: ("T", 0.0) for w in TARGET} | {w: ("N", 0.0) for w in NEGATION}
        self.known |= {w: ("R", 0.0) for w in REPORTED} | {w: ("V", 1.0) for w in THREAT}

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's symbol and weight, worked out once for each different word."""
        found = self.symbols.get(word)
        if found is None:
            if len(self.symbols) > 500_000:
                self.symbols.clear()
            weight = max((self.insults.get(f, 0.0) for f in forms(word)), default=0.0)
            found = ("I", weight) if weight else self.known.get(word, ("-", 0.0))
            self.symbols[word] = found
        return found

    def read(self, text: str | None) -> list[float]:
        """Weights by pattern, in the order of PATTERNS."""
        sums = dict.fromkeys(PATTERNS, 0.0)
        tokens = _TOKEN.findall((text or "").lower())
        marked = [self.symbol(t) for t in tokens]
        if not any(s in "IV" for s, _ in marked if s != "-"):
            return [0.0] * len(PATTERNS)
        start = 0
        for at, token in enumerate([*tokens, "."]):
            if token in _ENDS:
                self._clause(tokens[start:at], marked[start:at], sums)
                start = at + 1
        return [math.log1p(sums[p]) if p != "strongest" else sums[p] for p in PATTERNS]

    @staticmethod
    def _clause(tokens: list[str], marked: list[tuple[str, float]], sums: dict[str, float]) -> None:
        target = reported = False
        negated = 0
        found: list[tuple[str, float]] = []
        threat = 0.0
        for token, (symbol, weight) in zip(tokens, marked):
            if token in _QUOTES or symbol == "R":
                reported = True
            elif symbol == "T":
                target = True
            elif symbol == "N":
                negated = _RECENT + 1
            elif symbol == "V" and not negated:
                threat += weight
            elif symbol == "I":
                found.append(("negated" if negated else "reported" if reported else "plain", weight))
            negated = max(0, negated - 1)
        if threat and target:
            sums["threat"] += threat
        for pattern, weight in found:
            sums["target" if pattern == "plain" and target else pattern] += weight
        if found:
            sums["clauses"] += 1
            sums["strongest"] = max(sums["strongest"], *(w for _, w in found))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, toxic, half, text`` of at most ``most`` labelled rows that are not held out."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = own.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id")) != 0)
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stored(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "toxicity-labels")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(chosen), "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    return stored(joined.select("doc_id", "toxic", half.alias("half"), "text"), "toxicity-training")


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_TOKEN.findall((text or "").lower()))
            counts.update((f, toxic) for f in {f for w in words if w[0].isalpha() for f in forms(w)})
        if counts:
            keys, n = zip(*counts.items())
            names, toxic = zip(*keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())],
                ["form", "toxic", "n"],
            )


def lexicon(rows: DataFrame) -> dict[str, float]:
    """The forms that toxic texts have far more often than others, with their log odds."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    counted = rows.select("toxic", "text").mapInArrow(_count_forms, "form string, toxic int, n bigint")
    sums = counted.groupBy("form").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("o"),
    )
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    telling = sums.withColumn("odds", odds).where((F.col("t") >= MIN_TOXIC) & (F.col("odds") >= MIN_ODDS))
    best = telling.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "form").limit(MAX_FORMS)
    return {r["form"]: float(r["odds"]) for r in best.collect()}


def _features(insults: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in batches:
            values = [grammar.read(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["key", "features"]
            )

    return run


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The insult lexicon and the weights of the patterns.

    The weights are learned from clauses that the lexicon of the other half of the training
    rows matches, so that they do not trust a form more than a new text will bear out.
    """
    rows = training(docs, labels)
    x, y = [], []
    for half in (0, 1):
        insults = lexicon(rows.where(F.col("half") != half))
        read = rows.where(F.col("half") == half).select(F.col("toxic").alias("key"), "text")
        # At most MAX_TRAIN rows of a few numbers.
        for r in read.mapInArrow(_features(insults), "key int, features array<double>").collect():
            x.append(r["features"])
            y.append(r["key"])
    weights = fit(np.array(x).reshape(-1, len(PATTERNS)), np.array(y, float))
    return lexicon(rows), weights


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document.

    Only the text goes into a score; null texts count as empty and score as texts without
    matched clauses.  Rows without id count as not held out and are never learned from.
    Repeated rows score alike; without labels every score is 0.5 or below.
    """
    insults, weights = learn(docs, labels)
    w = weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        x = np.array(w)
        for batch in batches:
            values = np.array([grammar.read(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(PATTERNS))
            scores = 1 / (1 + np.exp(-np.clip(values @ x[:-1] + x[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = narrow.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
