"""Toxicity scores by non-negative positive-unlabelled learning.

The classifiers are linear over hashed features of the words of a text: each lower-cased word
without punctuation at its ends, and its first three to eight letters. Only features whose share
of texts differs between confirmed and unlabelled ones by ``MIN_Z`` standard errors are used, so
that words of single texts are not learnt by heart; those a text has weigh the same, and have
unit length together. The shares are counted over all training rows, so the larger the table, the
rarer a word may be that tells.

Each classifier is trained on confirmed positives and on unlabelled texts (a sample of all
training rows, whatever their label). With the class prior p, the mean logistic loss ``R`` and
``+``/``-`` for the label that is assumed, the risk is

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

and where the second term of a batch falls below zero, the step goes up that term instead of
down, so that it cannot be driven to minus infinity by learning the positives by heart. The
prior is the share of positives among the labelled training rows. Scores are the mean
probability over ``SEEDS`` classifiers that differ in order and start.

The numpy trainer uses at most ``POSITIVES`` and ``UNLABELLED`` rows, those of the least hashes; these
bounds are parameters. Everything else reads all rows.

Defined results: null and empty texts have no features and get the score of the intercepts;
rows with equal ids or equal rows are scored each; of contradicting labels of one id, a positive
one counts; null ids have no label; without a positive or a labelled training row every score is
0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.llm.counts import TABLE, added, slices
from continuum.operators.joins import semi_join

BITS = 20
MAX_WORDS = 500_000  # entries of the dictionary that a Python worker keeps, some 110 MB
SLICES = 16  # rows that a table of feature counts is dealt into
PREFIXES = range(3, 9)
MIN_Z = 6.0
MIN_TEXTS = 5
POSITIVES = 3000
UNLABELLED = 9000
SEEDS = 3
EPOCHS = 20
BATCH = 400
RATE = 0.05
DECAY = 1e-5
_LAST = (1 << BITS) - 1
_EDGE = ".,;:!?\"'()[]*#$%&|-_…“”‘’«»¡¿"


class Features(dict):
    """Word to its feature numbers as bytes; emptied when it grows too large."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        bare = word.lower().strip(_EDGE)
        data = bare.encode("utf-8", "replace")
        if len(data) == len(bare):  # one byte a character
            parts = [data[:k] for k in PREFIXES if len(data) >= k]
        else:
            parts = [bare[:k].encode("utf-8", "replace") for k in PREFIXES if len(bare) >= k]
        numbers = [zlib.crc32(x) & _LAST for x in (b"=" + data, *parts)] if bare else []
        self[word] = value = array("i", numbers).tobytes()
        return value


_features = Features()


def features(text: str) -> np.ndarray:
    """The different feature numbers of a text, ascending."""
    joined = b"".join(map(_features.__getitem__, set(text.split())))
    return np.unique(np.frombuffer(joined, np.int32))


def telling(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int) -> np.ndarray:
    """For each feature number its place among the features in use, or -1.

    ``p`` of ``n_p`` confirmed and ``u`` of ``n_u`` unlabelled texts have the feature.
    """
    share = (p + u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_p + 1 / n_u))
    used = (np.abs(p / n_p - u / n_u) >= MIN_Z * error) & (p + u >= MIN_TEXTS)
    return np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)


def in_use(numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = places[numbers]
    return at[at >= 0]


class Rows:
    """Sparse rows laid end to end."""

    def __init__(self, numbers: list[np.ndarray]):
        self.size = np.array([len(n) for n in numbers], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.number = np.concatenate(numbers)
        self.weight = np.repeat(1 / np.sqrt(np.maximum(self.size, 1)), self.size)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (0, 1, ...), number and weight of every feature in the chosen rows."""
        size = self.size[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size)
        return owner, self.number[at], self.weight[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: Rows, unlabelled: Rows, n_features: int, prior: float, seed: int) -> np.ndarray:
    """Weights and, last, the intercept of one classifier, by Adam."""
    rng = np.random.default_rng(seed)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    n_batches = max(1, -(-len(unlabelled.size) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        p_order = np.array_split(rng.permutation(len(positive.size)), n_batches)
        u_order = np.array_split(rng.permutation(len(unlabelled.size)), n_batches)
        for p_rows, u_rows in zip(p_order, u_order, strict=True):
            if not len(p_rows):
                p_rows = rng.integers(0, len(positive.size), 1)
            slopes = []
            parts = []
            for rows, chosen in ((positive, p_rows), (unlabelled, u_rows)):
                owner, number, weight = rows.take(chosen)
                z = np.bincount(owner, weights=w[number] * weight, minlength=len(chosen)) + w[-1]
                parts.append((owner, number, weight))
                slopes.append(z)
            zp, zu = slopes
            negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            dp_plus = -prior * _sigmoid(-zp) / len(zp)
            dp_minus = -prior * _sigmoid(zp) / len(zp)
            du = _sigmoid(zu) / len(zu)
            if negative_risk < 0:
                dp, du = -dp_minus, -du
            else:
                dp = dp_plus + dp_minus
            gradient = DECAY * w
            for d, (owner, number, weight) in zip((dp, du), parts, strict=True):
                gradient += np.bincount(number, weights=d[owner] * weight, minlength=len(w))
                gradient[-1] += d.sum()
            step += 1
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient * gradient - square)
            w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def _extract(batches):
    for batch in batches:
        numbers = [features(t).tobytes() for t in batch["text"]]
        yield pd.DataFrame({"chance": batch["chance"], "number": numbers})


def _texts_with(batches):
    """How many texts of a task have each feature, and, last, how many there are."""
    total = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for text in batch["text"]:
            total[features(text)] += 1  # the features of a text are different
        total[-1] += len(batch)
    yield slices(total, SLICES)


def _counted(texts: DataFrame) -> tuple[np.ndarray, int]:
    total = added(texts.select("text").mapInPandas(_texts_with, TABLE), SLICES)
    return (total[:-1], int(total[-1])) if len(total) else (np.zeros(1 << BITS, np.int64), 0)


def _sample(texts: DataFrame, n: int, of: int) -> list[np.ndarray]:
    """Features of the ``n`` rows of the least hashes among ``of``."""
    wide = texts.filter(F.col("chance") < min(1.0, 1.5 * n / max(of, 1) + 1e-6))
    least = wide.mapInPandas(_extract, "chance double, number binary").orderBy("chance", "number").limit(n)
    return [np.frombuffer(x, np.int32) for x in least.toPandas()["number"]]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature places and one row of weights per classifier; none if there is nothing to learn from.

    ``docs``: ``doc_id, text``. ``labels``: ``doc_id, toxic``, of training rows only.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    n_labelled, n_positive = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not n_positive:
        return None
    prior = min(max(n_positive / n_labelled, 1e-3), 1 - 1e-3)
    text = F.coalesce("text", F.lit(""))
    chance = F.pmod(F.xxhash64("doc_id", text, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    unlabelled = docs.select("doc_id", text.alias("text"), chance.alias("chance"))
    confirmed = semi_join(unlabelled, marked.filter("toxic = 1").select("doc_id"), "doc_id")
    (p, n_p), (u, n_u) = _counted(confirmed), _counted(unlabelled)
    if not n_p or not n_u:
        return None
    places = telling(p, n_p, u, n_u)
    n_features = int(places.max()) + 1
    chosen = (_sample(confirmed, POSITIVES, n_p), _sample(unlabelled, UNLABELLED, n_u))
    p, u = (Rows([in_use(n, places) for n in side]) for side in chosen)
    return places, np.array([train(p, u, n_features, prior, seed) for seed in range(SEEDS)])


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``doc_id, score`` for each row."""
    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            result = np.zeros(len(batch))
            if shared.value is not None:
                places, weights = shared.value
                for i, text in enumerate(batch["text"]):
                    at = in_use(features(text), places)
                    total = weights[:, at].sum(axis=1) / np.sqrt(max(len(at), 1))
                    result[i] = _sigmoid(total + weights[:, -1]).mean()
            yield pd.DataFrame({"key": batch["key"], "score": result})

    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(score, "key string, score double").select(F.col("key").cast(kind).alias("doc_id"), "score")
