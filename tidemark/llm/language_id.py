"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (of one to three bytes) that both hold, over the geometric mean of
their own numbers. A Nyström sample of landmark texts turns it into vectors; kernel ridge regression, one language
against the rest, is solved on those. A batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, small, text_bytes
from tidemark.llm.grams import hashed_grams
from tidemark.llm.toxicity import held_out

ORDERS, BITS = (1, 2, 3), 14
#: About so many texts of each language are learned from, at most ALL_TEXTS; and so many are landmarks.
TEXTS, ALL_TEXTS, LANDMARKS = 600, 8_000, 128


def presence(column: pa.Array) -> np.ndarray:
    """One row per text with 1 for each hashed n-gram it holds."""
    rows = np.zeros((len(column), 1 << BITS), np.float32)
    for text, bucket in hashed_grams(column, ORDERS, BITS):
        rows[text, bucket] = 1
    return rows


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(rows.sum(1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(1), 1))
        return (rows @ self.landmarks.T) / own

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows) @ self.weights


def fit(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """One-versus-rest kernel ridge regression; landmarks are dealt evenly to the languages."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    turn = np.empty(len(label), int)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    order = np.lexsort((label, turn))[:landmarks]
    model = Model(names, rows[order], np.empty(0))
    between = model.kernel(rows[order]).astype(float)
    values, vectors = np.linalg.eigh(between)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel(rows).astype(float) @ root
    goal = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ phi + ridge * len(rows) / 100 * np.eye(phi.shape[1]), phi.T @ goal)
    model.weights = root @ solved
    return model


def train(rows: DataFrame, texts: int = TEXTS) -> Model | None:
    """Learn from ``rows(key, text, lang)``: per language about ``texts`` rows, picked by a hash of key and text.

    The driver gets the sampled texts' n-gram presence, 2 KB each, for at most ALL_TEXTS texts. None without rows.
    """
    letters = rows.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    sizes = letters.groupBy("lang").agg(F.count("*").alias("of"))
    # Many languages share the bound on all texts.
    each = min(texts, max(1, ALL_TEXTS // max(1, sizes.count())))
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = letters.join(small(sizes), "lang").withColumn("_h", chance).where(F.col("_h") * F.col("of") < each)

    def bits(parts):
        for batch in parts:
            rows = [np.packbits(x > 0).tobytes() for x in presence(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("_h"), pa.array(rows, pa.binary())], ["lang", "h", "bits"]
            )

    gathered = arrow_map(
        picked.select("lang", "_h", text_bytes("text").alias("text")), bits, "lang string, h double, bits binary"
    ).collect()
    if not gathered:
        return None
    gathered.sort(key=lambda r: (r.h, r.bits))
    matrix = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in gathered]).astype(np.float32)
    return fit(matrix, [r.lang for r in gathered])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` for every row; the score is a softmax share."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(parts):
        model = spread.value
        for batch in parts:
            known = np.asarray(batch.column("letters")).astype(bool)
            names, values = np.full(len(batch), "und", object), np.zeros(len(batch))
            if model is not None and known.any():
                scores = 4 * model.scores(presence(batch.column("text")))
                share = np.exp(scores - scores.max(1, keepdims=True))
                best = share.argmax(1)
                names = np.where(known, np.array(model.languages, object)[best], names)
                values = np.where(known, share.max(1) / share.sum(1), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_bytes(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return arrow_map(texts, rows, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang)``.

    Learned from text and lang outside the fold crc32(doc_id as text) mod 4 = 2. A null text or one without a letter is
    ``und`` with score 0, and so is every text if no row has a lang. Ties go to the language first in order. Repeated
    rows get equal results; extra columns are ignored; an empty table gives no rows.
    """
    known = docs.where(~held_out("doc_id", 4, 2)).select(
        F.col("doc_id").alias("key"), "text", F.col("lang").cast("string").alias("lang")
    )
    found = predict(docs, train(known, **options))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
