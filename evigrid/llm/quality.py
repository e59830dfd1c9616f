"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text is cut into runs of letters, digits, or other signs. Each run gives two hashed streams: the run itself in lower case, and
its shape (all lower, capitalised, all upper, digits, or the signs as they are). Features are the n-grams of both streams;
a text's vector is its n-gram frequencies, so length does not change the scale of a score. Scores are sparse dot products with the
weights, a fixed array which is sent to every task once.

Training takes labelled rows only: ``train_rows`` of them at most, the smallest hashes of the ids (a stated sample; its bound keeps
the model's fit in one task per shard). Shards run the FTRL-proximal updates over their rows in parallel and their weights
are averaged. Nothing but the text is an input of a score.

Defined cases: a null or empty text has no feature and scores the intercept; repeated documents score alike; a document with
several labels counts as good if any is; no usable label gives the score 0.5 everywhere; null labels and ids never train.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import id_and_text, map_batches, ship, text_function, whole_text

BUCKETS = 1 << 18
TRAIN_ROWS = 16_000
SHARDS = 4
EPOCHS = 4
SCALE = 24.0
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
_RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_REPEAT = np.uint64(zlib.crc32(b"shape again"))


def _code(run: str) -> int:
    """Hashes of a run (upper half) and of its shape (lower half)."""
    if run.isalpha():
        shape = "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a"
    elif run.isdigit():
        shape = f"9:{min(len(run), 6)}"
    else:
        shape = run[:8]
    word = zlib.crc32(run.lower().encode("utf-8", "replace"))
    return word << 32 | zlib.crc32(b"shape" + shape.encode("utf-8", "replace"))


class _Codes(dict):
    """Codes of recent runs; emptied when it grows over a limit, so memory stays bounded."""

    def __missing__(self, run: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        code = self[run] = _code(run)
        return code


_CODES = _Codes()


def features(text: str) -> np.ndarray:
    """Bucket numbers of all n-grams of a text, repeats included."""
    runs = _RUN.findall(text)
    if not runs:
        return np.empty(0, dtype=np.int64)
    codes = np.fromiter(map(_CODES.__getitem__, runs), dtype=np.uint64, count=len(runs))
    word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    # a run that repeats the one before has a shape of its own
    shape[1:][word[1:] == word[:-1]] = _REPEAT
    odd = (np.uint64(0x9E3779B1), np.uint64(0x85EBCA77), np.uint64(0xC2B2AE3D))
    parts = [
        word * odd[0],
        (word[:-1] * odd[1] + word[1:] * odd[2]) ^ np.uint64(0x5BD1E995),
        (shape[:-1] * odd[2] + shape[1:] * odd[0]) ^ np.uint64(0x27D4EB2F),
        (shape[:-2] * odd[0] + shape[1:-1] * odd[1] + shape[2:] * odd[2]) ^ np.uint64(0x165667B1),
    ]
    mixed = np.concatenate(parts)
    return ((mixed ^ (mixed >> np.uint64(21))) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float


def ftrl(rows: Iterable[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal with per-coordinate rates over (bucket numbers, label) rows, in the order given."""
    z = np.zeros(BUCKETS + 1)
    n = np.zeros(BUCKETS + 1)
    compact = []
    for found, label in rows:
        index, count = np.unique(found, return_counts=True)
        value = count * (SCALE / max(1, len(found)))
        # 32 bits are plenty for buckets and frequencies, and all rows of a shard stay in memory
        compact.append((np.append(index, BUCKETS).astype(np.int32), np.append(value, 1.0).astype(np.float32), label))
    for _ in range(epochs):
        for index, value, label in compact:
            zi, ni = z[index], n[index]
            w = _weights(zi, ni)
            w[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA + L2)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            root = np.sqrt(ni + g * g)
            z[index] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
    w = _weights(z, n)
    return Model(w[:BUCKETS].astype(np.float32), float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score_text(model: Model, text: str) -> float:
    found = features(text)
    total = model.intercept + (SCALE * float(model.weights[found].sum(dtype=np.float64)) / len(found) if len(found) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def held_out(id_col: str = "doc_id") -> Column:
    """One document in five, by the CRC-32 of its id as text, is kept out of training."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, shards: int = SHARDS) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    usable = (
        labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("labelled").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("labelled"))
        .groupBy("labelled").agg(F.max("quality").alias("quality"))
    )
    order = F.xxhash64(F.col("labelled").cast("string"))
    # at most train_rows ids and labels, whatever the input: safe to send to every task
    sample = usable.orderBy(order, "labelled").limit(train_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("labelled")
    )
    rows = found.select("text", "quality", order.alias("at"), F.pmod(order, F.lit(shards)).cast("int").alias("shard"))

    ship(docs.sparkSession)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "text"], kind="stable")
        model = ftrl((features(t), q) for t, q in zip(frame["text"], frame["quality"], strict=True))
        return pd.DataFrame({"rows": [len(frame)], "weights": [model.weights.tobytes()], "intercept": [model.intercept]})

    # a task per shard: hashing few numbers would put several into one
    dealt = rows.repartitionByRange(shards, "shard")
    fitted = dealt.groupBy("shard").applyInPandas(fit, "rows bigint, weights binary, intercept double").collect()
    total = sum(r.rows for r in fitted)
    if not total:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    weights = sum(np.frombuffer(r.weights, dtype=np.float32) * (r.rows / total) for r in fitted)
    return Model(np.asarray(weights, dtype=np.float32), sum(r.intercept * r.rows for r in fitted) / total)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher is better), ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "score": [score_text(shared.value, t) for t in batch.column("text").to_pylist()],
        }

    source = id_and_text(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = map_batches(source, run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents which the classifier does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    ship(docs.sparkSession)

    rate = text_function(lambda texts: [score_text(shared.value, t.decode()) for t in texts], "double")
    return docs.where(rate(whole_text()) >= threshold)
