"""Language ID by string kernels.

The kernel of two texts is the normalised number of byte n-grams (1 to 3, lower
case, presence only) that both hold: a blended spectrum, hashed. Landmark texts
give a Nyström approximation, in which one-versus-rest kernel ridge regression
is solved. Documents are scored by matrix products of a batch with the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.sampling import SPACE
from hirelens.sources.shared import scratch_folder, stored

SHIFT = 32 - 13
BUCKETS = 1 << (32 - SHIFT)
BLOCK = 1 << 22
BATCH = 128
SENT = 1 << 18
NO_LANGUAGE = "und"
LETTER = regex.compile(r"\p{L}")  # the Unicode categories of letters, not of numbers


def grams(text: str) -> np.ndarray:
    """Buckets of the text's n-grams, in blocks that overlap by two bytes."""
    data, present = text.lower().encode(), np.zeros(BUCKETS, bool)
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + 2, len(data) - at), at).astype(np.uint32)
        for n in (1, 2, 3):
            code = np.uint32(n << 28)
            for i in range(n):
                code = code + (b[i : len(b) - n + 1 + i] << np.uint32(8 * i))
            present[(code * np.uint32(2654435761)) >> np.uint32(SHIFT)] = True
    return present


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # landmarks by buckets, each row of length 1
    weights: np.ndarray  # landmarks by languages


def kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of rows of presence with the landmarks; empty rows give 0."""
    length = np.sqrt(present.sum(axis=1, keepdims=True))
    return (present @ landmarks.T) / np.maximum(length, 1)


def fit(texts: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> LanguageModel:
    """``texts``: language and presence, in a fixed order. Landmarks go round the languages."""
    languages = tuple(sorted({lang for lang, _ in texts}))
    if not languages:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0), np.float32))
    turn, order = dict.fromkeys(languages, 0), []
    for i, (lang, _) in enumerate(texts):
        order.append((turn[lang], lang, i))
        turn[lang] += 1
    chosen = [i for _, _, i in sorted(order)[: max(landmarks, len(languages))]]
    x = np.stack([p for _, p in texts]).astype(np.float32)
    marks = x[chosen] / np.maximum(np.sqrt(x[chosen].sum(axis=1, keepdims=True)), 1)
    k, among = kernel(x, marks).astype(float), (marks @ marks.T).astype(float)
    y = np.where(np.array([[lang == known for known in languages] for lang, _ in texts]), 1.0, -1.0)
    weights = np.linalg.lstsq(k.T @ k + ridge * len(x) * among + 1e-8 * np.eye(len(among)), k.T @ y, rcond=None)[0]
    return LanguageModel(languages, marks, weights.astype(np.float32))


def train(
    learned: DataFrame, *, per_language: int = 300, landmarks: int = 192, ridge: float = 1e-5
) -> LanguageModel:
    """Fit on (text, lang); rows without either are left out, repeated ones count once.

    The sample is bounded: of each language the ``per_language`` distinct texts
    with the smallest hashes. Only their presence vectors come to the driver.
    """
    rows = learned.where("text is not null and lang is not null").select(
        "lang", "text", F.xxhash64("text").alias("hash")
    )
    # Of a frequent language a cut by hash leaves a few more than are wanted, before they are ranked.
    distinct = rows.select("lang", "hash").distinct()
    sizes = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    share = F.least(F.lit(1.0), 1.3 * (per_language + 20) / F.col("size"))
    place = F.pmod("hash", F.lit(SPACE))
    smallest = Window.partitionBy("lang").orderBy(place, "hash")
    chosen = (
        distinct.join(sizes, "lang")
        .where(place < share * SPACE)
        .withColumn("rank", F.row_number().over(smallest))
        .where(F.col("rank") <= per_language)
        .select("lang", "hash")
    )
    chosen = stored(chosen, scratch_folder(learned.sparkSession, "languages"))
    if chosen.count() <= SENT:  # else there are very many languages, and both sides are joined by shuffle
        chosen = F.broadcast(chosen)

    @F.pandas_udf("binary")
    def presence(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(grams(t)).tobytes() for t in texts], dtype=object)

    sample = (
        rows.join(chosen, ["lang", "hash"])
        .dropDuplicates(["lang", "hash"])
        .select("lang", "hash", presence("text").alias("bits"))
        .collect()
    )
    texts = [
        (r.lang, np.unpackbits(np.frombuffer(r.bits, np.uint8)))
        for r in sorted(sample, key=lambda r: (r.lang, r.hash))
    ]
    return fit(texts, landmarks, ridge)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (text, ...) with lang_pred and score, from the text alone.

    A null text, one without letters, or a model that learned nothing gives
    ``und`` and score 0. Ties go to the first language by name. Repeated rows
    are judged as often as they occur; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names, scores = [], []
            for at in range(0, len(texts), BATCH):
                part = texts.iloc[at : at + BATCH].tolist()
                if not m.languages:
                    names += [NO_LANGUAGE] * len(part)
                    scores += [0.0] * len(part)
                    continue
                present = np.stack([grams(t or "") for t in part]).astype(np.float32)
                values = kernel(present, m.landmarks) @ m.weights
                best = values.argmax(axis=1)
                for t, row, b in zip(part, values, best):
                    known = bool(t) and LETTER.search(t) is not None
                    names.append(m.languages[b] if known else NO_LANGUAGE)
                    scores.append(float(np.clip((row[b] + 1) / 2, 0, 1)) if known else 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": np.array(scores, float)})

    judged = F.pandas_udf(judge, "lang_pred string, score double")
    rows = docs.select(F.struct("*").alias("row"), judged("text").alias("judged"))
    return rows.select(
        *(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")),
        "judged.lang_pred",
        "judged.score",
    )
