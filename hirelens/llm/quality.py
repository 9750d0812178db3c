"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-
maximisation over the counts of all vote patterns estimates how accurate each
labeller is and what share is good; the posteriors of a bounded sample train a
linear scorer of hashed text-shape n-grams, which judges every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hirelens.llm.sampling import small_hashes

GOOD, BAD, NOTHING = 2, 1, 0
BUCKETS = 1024
FEW = 30  # added to lengths, so that a share in a few characters says little
SHARE = 0.3  # weight of the prior against that of the documents
BLOCK = 1 << 22
SYMBOLS = b"#$%&*|!<>{}=+~^_\\/@[]"
UPPER = bytes(range(65, 91))
# Shape of a byte: upper case, lower case or part of another letter, digit, blank; marks as they are.
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 1, 2, 2, 3
SHAPE[[9, 11, 12, 13]] = 32


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on."""
    return GOOD if value <= good else BAD if value >= bad else NOTHING


# What the labellers look at, in the order of their votes.
LABELLERS = (
    "repeated_neighbours", "repeated_pairs", "commonest_word", "upper_case", "symbols", "bars", "shouts",
    "marked_words", "sentences", "word_length",
)


def facts(text: str) -> tuple[list[str], float, float]:
    """Words, the (shrunk) share of words that repeat the one before, the share of the commonest word."""
    words = text.split()
    n = len(words)
    if not n:
        return words, 0.0, 0.0
    again = sum(map(str.__eq__, words, words[1:])) / (n + 10)  # in a few words one repeat says little
    return words, again, Counter(words).most_common(1)[0][1] / n


def votes(text: str) -> str:
    """One digit per labeller. A text without words is bad to those that need words."""
    words, again, commonest = facts(text)
    n = len(words)
    if not n:
        return "".join(map(str, [BAD] * len(LABELLERS)))
    data = text.encode()
    size = len(data)
    upper = size - len(data.translate(None, UPPER))
    symbols = size - len(data.translate(None, SYMBOLS))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in words) / n
    stops = data.count(b".") + data.count(b"?")
    chars = (len(text) - n + 1) / n
    found = (
        _vote(again, 0.02, 0.1) if n >= 5 else NOTHING,
        _vote(1 - len(set(zip(words, words[1:]))) / (n - 1), 0.3, 0.5) if n >= 20 else NOTHING,
        _vote(commonest, 0.12, 0.2) if n >= 30 else NOTHING,
        _vote(upper / (size + FEW), 0.1, 0.2),
        _vote(symbols / (size + FEW), 0.01, 0.04),
        _vote(text.count(" | ") / n, 0.02, 0.1),
        _vote(text.count("!!") / n, 0.02, 0.1),
        _vote(marked, 0.05, 0.2),
        NOTHING if n < 30 else GOOD if 1 / 60 <= stops / n <= 0.5 else BAD,
        GOOD if 2 <= chars <= 12 else BAD,
    )
    return "".join(map(str, found))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed shape trigrams, then two shares of repeats and 1."""
    _, again, commonest = facts(text)
    data, counts = text.encode(), np.zeros(BUCKETS)
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        shape = SHAPE[np.frombuffer(data, np.uint8, min(BLOCK + 2, len(data) - at), at)]
        code = (shape[:-2] << 16) | (shape[1:-1] << 8) | shape[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS)
    total = counts.sum()
    shares = np.sqrt(counts / (total + FEW))
    return np.concatenate([shares, [np.sqrt(again), commonest, 1.0]]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """good: prior; chances[labeller][vote] given good and bad; weights of the scorer."""

    good: float
    chances: np.ndarray
    weights: np.ndarray
    threshold: float = 0.5

    def posterior(self, pattern: str) -> float:
        return float(posteriors(np.array([list(map(int, pattern))]), self.good, self.chances)[0])


def posteriors(patterns: np.ndarray, good: float, chances: np.ndarray) -> np.ndarray:
    """Chance of good for each row of votes; chances has the shape (2, labellers, 3).

    A labeller that casts no vote says nothing: its chance is 1 for either class.
    """
    at = np.arange(patterns.shape[1])
    logs = np.log(chances[:, at, patterns]).sum(axis=2) + np.log([[1 - good], [good]])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Expectation-maximisation, started from the share of bad votes among those cast."""
    bads, cast = (patterns == BAD).sum(axis=1), (patterns != NOTHING).sum(axis=1)
    chance = np.clip(0.95 - 4 * bads / np.maximum(cast, 1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([(1 - chance) * counts, chance * counts])
        good = (weight[1].sum() + 1) / (counts.sum() + 2)
        cast = np.stack([weight @ (patterns == v) for v in (BAD, GOOD)], axis=2) + 1.0
        # Prior: no labeller sees every kind of bad text, and on good text all are mostly right.
        cast[0] += weight[0].sum() * SHARE / 2
        cast[1, :, 1] += weight[1].sum() * SHARE
        cast /= cast.sum(axis=2, keepdims=True)
        chances = np.concatenate([np.ones_like(cast[:, :, :1]), cast], axis=2)
        chance = posteriors(patterns, good, chances)
    return float(good), chances


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent."""
    now = ahead = np.zeros(x.shape[1])
    rate = 4.0 / max(float((x * x).sum(axis=1).mean()), 1e-9)
    for step in range(steps):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -500, 500))) - y) / len(y) + penalty * ahead
        new = ahead - rate * slope
        now, ahead = new, new + step / (step + 3) * (new - now)
    return now


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _votes_of():
    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(t) for t in texts], dtype=object)

    return vote(_text())


def train(docs: DataFrame, *, rows: int = 4000, threshold: float = 0.5) -> QualityModel:
    """Fit on ``docs`` (text): the labellers on all rows, the scorer on at most ``rows``.

    Only the counts of vote patterns (at most 3 to the number of labellers) and
    the sample's features come to the driver. The sample holds the distinct
    texts with the smallest hashes. Without rows every document scores 0.5.
    """
    texts = docs.select(_text().alias("text"))
    counted = (
        texts.select(_votes_of().alias("votes"), F.xxhash64("text").alias("hash"))
        .groupBy("votes")
        .agg(F.count(F.lit(1)).alias("count"), F.countDistinct("hash").alias("texts"))
        .orderBy("votes")
        .collect()
    )
    width = BUCKETS + 3
    if not counted:
        return QualityModel(0.5, np.ones((2, len(LABELLERS), 3)), np.zeros(width), threshold)
    patterns = np.array([list(map(int, r["votes"])) for r in counted])
    counts = np.array([r["count"] for r in counted], float)
    good, chances = estimate(patterns, counts)

    @F.pandas_udf("struct<votes: string, x: binary>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {"votes": [votes(t) for t in texts], "x": [features(t).tobytes() for t in texts]}
        )

    def smallest(total: int) -> list[Row]:
        return (
            small_hashes(texts, F.xxhash64("text"), total, rows)
            .select("__hash", measured("text").alias("m"))
            .orderBy("__hash")
            .limit(rows)
            .collect()
        )

    distinct = sum(r["texts"] for r in counted)  # equal texts have equal votes
    sample = smallest(distinct)
    if len(sample) < min(rows, distinct):  # the hashes lie unevenly: no cut
        sample = smallest(rows)
    x = np.stack([np.frombuffer(r.m.x, np.float32) for r in sample]).astype(np.float64)
    y = posteriors(np.array([list(map(int, r.m.votes)) for r in sample]), good, chances)
    return QualityModel(good, chances, fit_scorer(x, y), threshold)


def _judge(model: QualityModel):
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            score = [1 / (1 + np.exp(-np.clip(features(t) @ model.weights, -500, 500))) for t in texts]
            chance = [model.posterior(votes(t)) for t in texts]
            yield pd.DataFrame({"posterior": chance, "score": np.array(score, float)})

    return F.pandas_udf(judge, "posterior double, score double")


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, posterior, score, kept) for every row of ``docs`` (doc_id, text).

    posterior is the labellers' verdict, score the scorer's; kept is
    score >= threshold. Null and empty texts get the score of the empty text.
    """
    judged = docs.select("doc_id", _judge(model)(_text()).alias("__j"))
    return judged.select(
        "doc_id", "__j.posterior", "__j.score", (F.col("__j.score") >= model.threshold).alias("kept")
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` without the rows that the scorer rejects; all columns as they are."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [float(1 / (1 + np.exp(-np.clip(features(t) @ model.weights, -500, 500)))) for t in texts],
            dtype=float,
        )

    return docs.where(score(_text()) >= model.threshold)
