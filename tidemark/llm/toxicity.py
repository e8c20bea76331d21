"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are sets of hashed n-grams. Over a bounded sample of labelled rows, each n-gram's share among toxic and other texts
gives its log-count ratio; those that tell the classes apart best become features whose value is the ratio, scaled to
unit length per text, and logistic regression weighs them. Scoring is one pass over the whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, long_lists, saved, text_bytes
from tidemark.llm.grams import hashed_grams

ORDERS, BITS = (4, 5, 6), 20
#: At most about so many labelled rows are learned from; and so many n-grams become features.
SAMPLE, FEATURES = 30_000, 1_000
_SPLIT = 8


@dataclass
class Model:
    buckets: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.full(1 << BITS, -1, np.int16)
        table[self.buckets] = np.arange(len(self.buckets))
        return table


def features(column: pa.Array, table: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers of all features present, each once."""
    found = [np.empty(0, np.int64)]
    for text, bucket in hashed_grams(column, ORDERS, BITS):
        feature = table[bucket]
        hit = np.flatnonzero(feature >= 0)
        found.append(np.unique(text[hit].astype(np.int64) * n_features + feature[hit]))
    both = np.unique(np.concatenate(found))
    return both // n_features, both % n_features


def _linear(text, feature, ratios, weights, n):
    value = ratios[feature]
    scale = np.sqrt(np.bincount(text, value**2, n) + 1)
    return np.bincount(text, value * weights[feature], n) / scale


def _fit(text, feature, labels, ratios, rounds: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch gradient steps of adaptive size, from zero: the same result every time."""
    n, size = len(labels), len(ratios)
    value = ratios[feature]
    value = value / np.sqrt(np.bincount(text, value**2, n) + 1)[text]
    w, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for i in range(1, rounds + 1):
        score = np.bincount(text, w[feature] * value, n) + w[-1]
        off = 1 / (1 + np.exp(-score)) - labels
        step = np.append(np.bincount(feature, off[text] * value, size) / n + ridge * w[:-1], off.mean())
        mean, square = 0.9 * mean + 0.1 * step, 0.99 * square + 0.01 * step**2
        w -= 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-9)
    return w[:-1], float(w[-1])


def train(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """Learn from ``texts(id, text)`` and ``labels(id, label)``, label 0 or 1; rows with a null are left out.

    No more than about ``sample`` labels, picked by a hash of the id, are used, so what reaches the driver is bounded:
    the features' counts and, per sampled text, its feature numbers.
    """
    labels = labels.where("id IS NOT NULL AND label IN (0, 1)")
    total = labels.count()
    rate = min(1.0, sample / max(1, total))
    picked = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20))
    # The sample is bounded, so it may be broadcast and dealt to a fixed number of tasks.
    rows = texts.join(F.broadcast(picked), "id").select("text", F.col("label").cast("int").alias("label"))
    rows = saved(rows.repartition(_SPLIT), "labelled")

    def count(parts):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in parts:
            label = np.asarray(batch.column("label"))
            seen = [np.empty(0, np.int64)]
            for text, bucket in hashed_grams(batch.column("text"), ORDERS, BITS):
                seen.append(np.unique((text.astype(np.int64) << BITS) + bucket))
            both = np.unique(np.concatenate(seen))
            toxic = label[both >> BITS] == 1
            bucket = both & ((1 << BITS) - 1)
            counts[1] += np.bincount(bucket[toxic], minlength=1 << BITS)
            counts[0] += np.bincount(bucket[~toxic], minlength=1 << BITS)
        some = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], ["bucket", "q", "p"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_p, n_q = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((n_p + 1) / (n_q + 1)))
    if not n_p or not n_q:
        return Model(np.empty(0, np.int64), np.empty(0), np.empty(0), prior)
    p, q = (F.sum("p") + 1) / F.lit(n_p + 2.0), (F.sum("q") + 1) / F.lit(n_q + 2.0)
    apart = F.abs(p - q) / F.sqrt(p * (1 - p) / n_p + q * (1 - q) / n_q)
    chosen = (
        arrow_map(rows, count, "bucket long, q long, p long")
        .groupBy("bucket")
        .agg(F.log(p / q).alias("ratio"), apart.alias("apart"), F.sum(F.col("p") + F.col("q")).alias("n"))
        .where("n >= 3 AND ratio <> 0")
        .orderBy(F.desc("apart"), "bucket")
        .limit(n_features)
        .collect()
    )
    if not chosen:
        return Model(np.empty(0, np.int64), np.empty(0), np.empty(0), prior)
    model = Model(np.array([r.bucket for r in chosen]), np.array([r.ratio for r in chosen]), np.empty(0), 0.0)
    table = model.table()

    def present(parts):
        for batch in parts:
            text, feature = features(batch.column("text"), table, len(model.buckets))
            each = np.split(feature, np.searchsorted(text, np.arange(1, len(batch))))
            yield pa.RecordBatch.from_arrays([batch.column("label"), long_lists(each)], ["label", "features"])

    found = arrow_map(rows, present, "label int, features array<long>").toArrow()
    lists = found.column("features").combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    text = np.repeat(np.arange(len(lengths)), lengths)
    weights, bias = _fit(text, np.asarray(lists.flatten()), np.asarray(found.column("label")), model.ratios)
    return Model(model.buckets, model.ratios, weights, bias)


def _scores(column: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    linear = np.zeros(len(column))
    if len(model.buckets):
        text, feature = features(column, table, len(model.buckets))
        linear = _linear(text, feature, model.ratios, model.weights, len(column))
    return 1 / (1 + np.exp(-np.clip(linear + model.bias, -500, 500)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for every row; null and empty texts get the score that no feature gives."""
    spread = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    def rows(parts):
        for batch in parts:
            value = _scores(batch.column("text"), *spread.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value, pa.float64())], ["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return arrow_map(texts, rows, "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``; one pass, no shuffle."""
    spread = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    def rows(parts):
        for batch in parts:
            yield batch.filter(pa.array(_scores(batch.column(text_col), *spread.value) < threshold))

    return arrow_map(docs, rows, docs.schema)


def held_out(column: str, folds: int, fold: int):
    """Whether a row belongs to the fold that is never learned from; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def corpus_model(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model learned from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` outside the held-out fold."""
    known = labels.where(~held_out("doc_id", 5, 0)).select(
        F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("label")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes("text").alias("text"))
    return train(texts, known, **options)


def toxic_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Learned from ``labels(doc_id, toxic)`` outside the fold crc32(doc_id as text) mod 5 = 0. Scores depend on the text
    alone: repeated rows get equal ones, null and empty texts the one of a text without features. Without labels of
    both kinds every text gets the labels' share. Extra columns are ignored; an empty table gives no rows.
    """
    scored = score(docs, corpus_model(docs, labels, **options))
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
