"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pair term costs linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Features: damped shares of words in ``WORDS`` hash classes, the shares of ``text_stats``, and the size that the
table's own metadata states.  The model is fitted on the driver from a bounded, documented sample of labelled
training rows (``MOST_SAMPLE``); every document is scored, in one pass without a shuffle.

Defined results: null and empty texts have no words and get the score of that; a missing size is a feature of its own;
without labels of both kinds the score is the share of good labels (0.5 without any);
repeated rows are scored each; other columns are ignored, ids, language and source included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .labels import fold, training_sample
from .text_stats import counts, shares
from .ship import map_arrow
from .words import slices, text_bytes

WORDS = 2048
SHARE_NAMES = 10
DENSE = SHARE_NAMES + 3  # shares, stated size, missing size, length
FEATURES = WORDS + DENSE
RANK = 4
MOST_SAMPLE = 5_000  # labelled rows fitted on, FEATURES float32 each: 41 MB
EPOCHS = 30
BATCH = 256
THRESHOLD = 0.3
SLICE_ROWS = 1024


def features(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """rows x FEATURES; ``stated``: the metadata's size, nan if missing."""
    n = len(offsets) - 1
    found, w = counts(data, offsets)
    classes = (w.hash >> np.uint64(32)).astype(np.int64) % WORDS
    words = np.bincount(w.row_of() * WORDS + classes, minlength=n * WORDS).reshape(n, WORDS)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :WORDS] = np.sqrt(words / np.maximum(found["n_words"], 1)[:, None])
    dense = list(shares(found).values())
    dense += [np.log1p(np.nan_to_num(np.maximum(stated, 0))), np.isnan(stated), np.log1p(found["n_chars"])]
    out[:, WORDS:] = np.stack(dense, axis=1)
    return out


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray  # FEATURES x RANK
    middle: np.ndarray  # of the dense features
    spread: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Dense features to mean 0, deviation 1, held within five deviations of the training rows."""
        x[:, WORDS:] = np.clip((x[:, WORDS:] - self.middle) / self.spread, -5, 5)
        return x

    def logit(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        return self.bias + x @ self.weight + 0.5 * ((sums**2) - (x**2) @ (self.factors**2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.scaled(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss, with weight decay; rows must come in a fixed order."""
    rng = np.random.default_rng(seed)
    dense = x[:, WORDS:]
    middle = dense.mean(axis=0) if len(x) else np.zeros(DENSE)
    spread = np.maximum(dense.std(axis=0), 1e-6) if len(x) else np.ones(DENSE)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    m = Machine(np.log(share / (1 - share)), np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32), middle, spread)
    if len(np.unique(y)) < 2:
        return m
    m.factors = rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)
    x = m.scaled(x.copy())
    params = [np.array([m.bias], np.float32), m.weight, m.factors]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            part, step = x[rows], step + 1
            m.bias, m.weight, m.factors = params[0][0], params[1], params[2]
            sums = part @ m.factors
            error = (1 / (1 + np.exp(-np.clip(m.logit(part), -30, 30))) - y[rows]) / len(rows)
            slope = [
                np.array([error.sum()]),
                part.T @ error + 1e-4 * m.weight,
                part.T @ (sums * error[:, None]) - m.factors * ((part**2).T @ error)[:, None] + 1e-3 * m.factors,
            ]
            for i, g in enumerate(slope):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = 0.02 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                params[i] = (params[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(np.float32)
    m.bias, m.weight, m.factors = float(params[0][0]), params[1], params[2]
    return m


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        stated = batch.column("stated").to_numpy(zero_copy_only=False).astype(np.float64)
        for a, b in slices(offsets, rows=SLICE_ROWS):
            part = offsets[a : b + 1]
            yield batch.slice(a, b - a), features(data[part[0] : part[-1]], part - part[0], stated[a:b])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, x in _matrices(batches):
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), flat], ["id", "label", "x"])


def score_rows(machine: Machine, carry: list[str]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches):
            columns = [batch.column(c) for c in carry] + [pa.array(machine.score(x).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "score"])

    return step


def _inputs(documents: DataFrame, doc_id: str, text: str, size: str | None) -> DataFrame:
    stated = F.col(size).cast("double") if size and size in documents.columns else F.lit(None).cast("double")
    return documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), stated.alias("stated"))


def train(
    documents: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    size: str | None = "n_chars",
    most: int = MOST_SAMPLE,
) -> Machine:
    """A machine fitted on at most about ``most`` labelled training rows.

    The sample has a bounded size, so it is broadcast and the documents stay where they are.
    """
    sample = F.broadcast(training_sample(labels, doc_id, label, most))
    rows = _inputs(documents, doc_id, text, size).join(sample, "id")
    got = map_arrow(rows, _feature_rows, "id bigint, label int, x array<float>").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    y = got.column("label").to_numpy().astype(np.float32)
    # a fixed order, whatever order the tasks ended in
    order = np.lexsort((x[:, WORDS:].sum(axis=1), got.column("id").to_numpy()))
    return fit(x[order], y[order])


def score(documents: DataFrame, machine: Machine, *, doc_id: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """Per document row: id, score (0 to 1, higher is better)."""
    rows = _inputs(documents, doc_id, text, size)
    return map_arrow(rows, score_rows(machine, ["id"]), "id bigint, score double")


def drop_low_quality(documents: DataFrame, machine: Machine, *, text: str = "text", size: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, every column as it was, in one pass."""
    names = documents.columns
    stated = F.col(size).cast("double") if size and size in names else F.lit(None).cast("double")
    # the row travels as one struct, so no column name can clash
    rows = documents.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), stated.alias("stated"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])
    scored = map_arrow(rows, score_rows(machine, ["row"]), schema)
    return scored.filter(F.col("score") >= threshold).select("row.*")


def held_out(ident: str = "id"):
    return fold(ident) == 0
