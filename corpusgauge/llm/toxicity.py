"""Toxicity by classifier chains.

Categories are predicted one after another: the linear model of a category sees the text's
features and the probabilities of all categories before it.  While training, those
probabilities are out-of-fold predictions (each row's come from models that did not see it), so
a later model learns how far an earlier one can be trusted, not how well it knows its own rows.

Features are what a text contains (binary): words, and beginnings of longer words, so that an
inflected or compound form counts with its stem.  Of all words of the labelled rows those that
set positive rows apart are kept, by the difference of the two rates in their standard errors.

The label table has one label, so the categories are degrees of it: ``severe`` (toxic rows with
``severe_from`` or more of the kept features), ``insult`` (toxic rows with at least one) and
``toxic`` (the label itself), in this order; the last one is the verdict.

The verdict's threshold is chosen on the out-of-fold probabilities of the last category.

Training takes at most ``max_rows`` labels (those with the smallest hashes of their ids): a
proven bound, so the labels are broadcast and no text is moved.  Of these rows the counts of at
most ``candidates`` features and the chosen ``features`` columns come to the driver.  That bound
is the operator's only sample.  Scoring reads every whole text once, in place, without a
shuffle.

Null and empty texts have no features; a null label is no label.  Rows without positive labels
give a model that finds nothing.  Repeated rows are scored one by one, null ids stay, empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import byte_values, tune, written


@dataclass(frozen=True)
class ToxicityParams:
    max_rows: int = 20_000      # labelled rows that the models are fitted on
    features: int = 400         # columns
    candidates: int = 50_000    # features of positive rows, the most frequent, that are compared
    min_rows: int = 3           # positive rows that a feature must occur in
    min_z: float = 4.0          # standard errors between a feature's two rates
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)   # letters of a word's beginnings
    folds: int = 4
    l2: float = 0.5
    alarm_cost: float = 3.0     # a clean row called toxic weighs as much as so many missed toxic ones
    severe_from: int = 3        # different features of a severe row


# What is no letter separates words; A-Z in lower case.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def text_features(text: bytes | None, stems: tuple[int, ...]) -> set[bytes]:
    """Words and the beginnings of longer ones (marked with a *; their letters are bytes)."""
    found = set(text.translate(LETTERS).split()) if text else set()
    words = list(found)
    for n in stems:
        words = [w for w in words if len(w) > n]
        found |= {w[:n] + b"*" for w in words}
    return found


class Linear:
    """Logistic regression with an L2 penalty, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float):
        x = np.column_stack([x, np.ones(len(x))])
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], l2)
        ridge[-1] = 1e-6
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (q - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


class Chain:
    """The models of the categories in order, and the features' places."""

    def __init__(self, categories: list[str], vocabulary: list[bytes], models: list[Linear], p: ToxicityParams):
        self.categories, self.vocabulary, self.models, self.p = categories, vocabulary, models, p
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.threshold = 0.5

    def matrix(self, texts: list[bytes | None]) -> np.ndarray:
        x, names = np.zeros((len(texts), len(self.vocabulary))), self.place.keys()
        for i, text in enumerate(texts):
            for w in names & text_features(text, self.p.stems):
                x[i, self.place[w]] = 1.0
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories)."""
        out = np.empty((len(x), 0))
        for model in self.models:
            out = np.column_stack([out, model(np.column_stack([x, out]))])
        return out


def fit_chain(x: np.ndarray, labels: np.ndarray, p: ToxicityParams, seed: int = 11) -> tuple[list[Linear], np.ndarray]:
    """One model per column of ``labels``, and the out-of-fold probabilities that were fed on."""
    fold = np.random.default_rng(seed).integers(0, p.folds, len(x))
    seen, models = np.empty((len(x), 0)), []
    for y in labels.T:
        now = np.column_stack([x, seen])
        models.append(Linear(now, y, p.l2))
        held = np.zeros(len(x))
        for k in range(p.folds):
            inside = fold != k
            if (~inside).any() and inside.any():
                held[~inside] = Linear(now[inside], y[inside], p.l2)(now[~inside])
        seen = np.column_stack([seen, held])
    return models, seen


def best_threshold(q: np.ndarray, y: np.ndarray, cost: float) -> float:
    """The cut of the out-of-fold probabilities ``q`` with the most hits less ``cost`` per alarm,
    half-way between the probabilities on its two sides."""
    order = np.argsort(-q, kind="stable")
    q, gain = q[order], np.cumsum(np.where(y[order] > 0, 1.0, -cost))
    gain[:-1][q[1:] == q[:-1]] = -np.inf  # rows of one probability are on one side
    if not len(q) or gain.max() <= 0:
        return 0.5
    i = int(np.argmax(gain))
    return float((q[i] + (q[i + 1] if i + 1 < len(q) else 0)) / 2)


def labelled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, label_id_col: str,
             p: ToxicityParams) -> DataFrame:
    """(k, text, y): the documents of at most ``max_rows`` labels, those with the smallest hashes.

    The chosen labels are two numbers each and at most ``max_rows``, so they are broadcast and
    the texts stay where they are."""
    known = labels.select(F.col(f"`{label_id_col}`").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(
        "k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    known = written(known.orderBy(F.xxhash64("k"), "k").limit(p.max_rows), "labels")
    texts = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    return texts.join(F.broadcast(known), "k").select("k", "text", "y")


def feature_counts(rows: DataFrame, p: ToxicityParams, only: list[bytes] | None = None) -> DataFrame:
    """(w, n): the rows that have each feature (each of ``only``); counted in the tasks first."""
    wanted = None if only is None else set(only)

    def run(batches):
        count: dict[bytes, int] = {}
        for batch in batches:
            for text in byte_values(batch.column(0)):
                found = text_features(text, p.stems)
                for w in found if wanted is None else found & wanted:
                    count[w] = count.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(count, pa.binary()), pa.array(count.values(), pa.int64())], names=["w", "n"])

    return rows.select("text").mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def choose_features(rows: DataFrame, p: ToxicityParams) -> list[bytes]:
    """The features that set positive rows apart most, best first; ``rows`` has (text, y).

    Only features of positive rows can be chosen, so these are counted first, and the others'
    counts are taken of the ``candidates`` most frequent among them."""
    total = rows.agg(F.count_if(F.col("y") <= 0).alias("n0"), F.count_if(F.col("y") > 0).alias("n1")).first()
    if not total.n0 or not total.n1:
        return []
    n1 = {bytes(r.w): r.n for r in feature_counts(rows.filter("y > 0"), p).filter(F.col("n") >= p.min_rows).orderBy(
        F.desc("n"), "w").limit(p.candidates).collect()}
    n0 = {bytes(r.w): r.n for r in feature_counts(rows.filter("y <= 0"), p, list(n1)).collect()}
    found = []
    for w, a in n1.items():
        b = n0.get(w, 0)
        rate = (a + b) / (total.n0 + total.n1)
        z = (a / total.n1 - b / total.n0) / (rate * (1 - rate) * (1 / total.n0 + 1 / total.n1) + 1e-12) ** 0.5
        if z > p.min_z:
            found.append((-z, w))
    return [w for _, w in sorted(found)[:p.features]]


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
          label_id_col: str = "doc_id", p: ToxicityParams = ToxicityParams()) -> Chain:
    tune(docs.sparkSession)
    rows = labelled(docs, labels, text_col, id_col, label_col, label_id_col, p)
    vocabulary = choose_features(rows, p)
    categories = ["severe", "insult", "toxic"]
    chain = Chain(categories, vocabulary, [], p)
    if not vocabulary:
        return chain
    # only the chosen features of these rows come to the driver
    names = set(vocabulary)

    def run(batches):
        for batch in batches:
            found = [sorted(names & text_features(t, p.stems)) for t in byte_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary())), batch.column(1), batch.column(2)],
                                             names=["words", "y", "k"])

    key = rows.schema["k"].dataType.simpleString()
    held = rows.select("text", "y", "k").mapInArrow(run, f"words array<binary>, y int, k {key}")
    sample = sorted(held.collect(), key=lambda r: (r.k, r.words, r.y))  # the folds do not depend on the partitions
    x = np.zeros((len(sample), len(vocabulary)))
    for i, r in enumerate(sample):
        for w in r.words:
            x[i, chain.place[bytes(w)]] = 1.0
    toxic = np.array([float(r.y > 0) for r in sample])
    cues = x.sum(axis=1)
    chain.models, seen = fit_chain(x, np.column_stack([(cues >= p.severe_from) * toxic, (cues > 0) * toxic, toxic]), p)
    chain.threshold = best_threshold(seen[:, -1], toxic, p.alarm_cost)
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, a probability per category, toxic (the last one's verdict)."""
    tune(docs.sparkSession)
    cut, k = chain.threshold, len(chain.categories)
    schema = docs.select(F.col(f"`{id_col}`").alias("id")).schema
    for c in chain.categories:
        schema.add(f"p_{c}", "double")
    schema.add("toxic", "boolean")

    def run(batches):
        for batch in batches:
            q = (chain.predict(chain.matrix(byte_values(batch.column(1)))) if chain.models
                 else np.zeros((batch.num_rows, k)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(q[:, i]) for i in range(k)], pa.array(q[:, -1] >= cut)], names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("_0"), F.col(f"`{text_col}`").alias("_1")).mapInArrow(run, schema)
