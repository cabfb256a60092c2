"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all texts that may be learnt from. The weights are trained on a bounded sample by
follow-the-regularised-leader with elastic-net penalties, which leaves most of them at zero; a part of the sample that
was not trained on sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, ship_code, steps, written

#: Hashed features, and the lengths of n-grams.
FEATURES = 1 << 16
LENGTHS = (1, 2, 3)
UNKNOWN = "und"
#: Shares that each language's rows are drawn from.
SHARES = 64


class Settings(NamedTuple):
    """``per_language`` and ``sample`` bound the labelled rows that are trained on; all languages are learnt."""

    per_language: int = 1000
    sample: int = 4000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    rounds: int = 4
    calibrate: float = 0.2


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text in lower case, and how often each occurs."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, h = [], np.zeros(len(code), np.uint64)
    for n in LENGTHS:
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[n - 1 :] + np.uint64(n << 32))
        mixed = h * np.uint64(0xC2B2AE3D27D4EB4F)
        parts.append((mixed >> np.uint64(48)).astype(np.int64))
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(every) > FEATURES // 8:
        counts = np.bincount(every, minlength=FEATURES)
        at = np.flatnonzero(counts)
        return at, counts[at]
    return np.unique(every, return_counts=True)


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their TF-IDF weights, of length one in all."""
    at, counts = grams(text)
    value = (1 + np.log(counts)) * idf[at]
    norm = math.sqrt(float(value @ value))
    return at, value / norm if norm else value


def document_frequencies(texts: DataFrame) -> DataFrame:
    """Columns feature and n over the column text; a task sums up before anything is shuffled. Feature -1: documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(FEATURES, np.int64), 0
        for batch in steps(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    counts[grams(text)[0]] += 1
                    n += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["feature", "n"]
        )

    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights by class and feature, and the temperature, from rows of features, weights and class in a fixed order.

    The first rows, as many as there are classes, are always trained on.
    """
    cut = max(classes, round(len(rows) * (1 - s.calibrate))) if len(rows) >= 20 else len(rows)
    z, n = np.zeros((classes, FEATURES)), np.zeros((classes, FEATURES))

    def weights(at):
        za = z[:, at]
        return np.where(
            np.abs(za) <= s.l1, 0.0, -(za - np.sign(za) * s.l1) / ((s.beta + np.sqrt(n[:, at])) / s.alpha + s.l2)
        )

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    for _ in range(s.rounds):
        for at, value, label in rows[:cut]:
            w = weights(at)
            gradient = softmax(w @ value)
            gradient[label] -= 1
            g = gradient[:, None] * value
            squared = g * g
            before = n[:, at]
            z[:, at] += g - (np.sqrt(before + squared) - np.sqrt(before)) / s.alpha * w
            n[:, at] = before + squared
    full = weights(np.arange(FEATURES))
    scores = [(full[:, at] @ value, label) for at, value, label in rows[cut:] or rows]

    def loss(t):
        return -sum(math.log(max(softmax(x / t)[label], 1e-12)) for x, label in scores)

    low, high = math.log(0.05), math.log(20.0)
    for _ in range(30):  # golden section
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, high)
    return full, math.exp((low + high) / 2)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, value = weighted(text, self.idf)
        x = self.weights[:, at] @ value / self.temperature
        e = np.exp(x - x.max())
        best = int(e.argmax())
        return self.languages[best], min(1.0, float(e[best] / e.sum()))


def sample(usable: DataFrame, languages: int, settings: Settings) -> DataFrame:
    """The rows that are trained on, with their draw: none twice, and at least one of each of the ``languages``."""
    keys = usable.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("draw")).distinct()
    # A language is cut down in shares first, so that one with most of the rows isn't a single task's work.
    share = F.pmod("draw", F.lit(SHARES))
    for by in (Window.partitionBy("lang", share), Window.partitionBy("lang")):
        number = F.row_number().over(by.orderBy("draw", "doc_id"))
        keys = keys.withColumn("n", number).where(F.col("n") <= settings.per_language)
    drawn = keys
    # Each language's first row comes before any second one, so the sample holds every language.
    most = max(settings.sample, languages)
    drawn = written(drawn.orderBy("n", "draw", "lang").limit(most).select("doc_id", "draw", "lang"), "language-sample")
    by = ["doc_id", "draw", "lang"]
    rows = usable.withColumn("draw", F.xxhash64("doc_id", "text")).join(drawn, by, "left_semi")
    return rows.dropDuplicates(by)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the columns doc_id, text and lang; rows without text or language are passed over.

    Only the weights come to the driver, FEATURES of each language at most: the sample is trained on in one task, whose
    rows ``settings`` bounds, but for one row of each language, which is always drawn. The sample is drawn by a hash of
    doc_id and text, so that it doesn't depend on the partitions; rows that repeat are drawn once.
    """
    spark = labelled.sparkSession
    ship_code(spark)
    usable = labelled.where("text is not null and text != '' and lang is not null").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    idf = np.zeros(FEATURES)
    counts = {r.feature: r.n for r in document_frequencies(usable.select("text")).collect()}
    total = counts.pop(-1, 0)
    idf[:] = math.log(1 + total)
    for feature, n in counts.items():
        idf[feature] = math.log((1 + total) / (1 + n)) + 1e-3
    languages = sorted(r.lang for r in usable.select("lang").distinct().collect())
    if not languages:
        return Model([], idf, np.zeros((0, FEATURES)), 1.0)
    rows = sample(usable, len(languages), settings)
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for draw, text, lang in zip(*(batch.column(c).to_pylist() for c in ("draw", "text", "lang")), strict=True):
                held.append((draw, lang, *weighted(text, shared.value)))
        held.sort(key=lambda x: (x[0], x[1]))
        # A row of each language comes first, so that no language is left to calibration alone.
        met: set[str] = set()
        held.sort(key=lambda x: x[1] in met or met.add(x[1]) is not None)
        number = {c: i for i, c in enumerate(languages)}
        full, temperature = train([(at, v, number[lang]) for _, lang, at, v in held], len(languages), settings)
        at = np.flatnonzero(full.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()]), pa.array([[temperature], *full[:, at].T.tolist()], pa.list_(pa.float64()))],
            ["feature", "weights"],
        )

    weights, temperature = np.zeros((len(languages), FEATURES)), 1.0
    for r in rows.repartition(1).mapInArrow(run, "feature long, weights array<double>").collect():
        if r.feature < 0:
            temperature = r.weights[0]
        else:
            weights[:, r.feature] = r.weights
    return Model(languages, idf, weights, temperature)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred and score of every whole text; texts without a letter are ``und`` with score 0.

    Of languages that score alike the first by name is taken. No column beside ``keep`` and text is read. Without any
    language learnt every text is ``und``. The model is broadcast: FEATURES x (languages + 1) numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        found = [shared.value.predict(t) for t in texts]
        return [[x[0] for x in found], [x[1] for x in found]]

    return map_texts(docs, list(keep), [("lang_pred", "string"), ("score", "double")], work)


def held_out(docs: DataFrame) -> DataFrame:
    """Adds held_out: the checksum of doc_id as text leaves 2 when divided by 4; false without a doc_id."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False)))
