"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network with temperature-calibrated probabilities.

Tokens are runs of letters, of digits or of other signs (A-Z lower-cased), and
for each run of letters its case pattern.  Each token falls into one of
``VOCABULARY`` buckets.  A bucket has a sparse random index vector; its word
vector is the sum of the index vectors of its neighbours in the whole corpus
(partial sums in each task, added by bucket in Spark), normalised, next to its
own index vector.  A document is the mean of its tokens' vectors with its log
length and its share of distinct tokens.  The network is fitted on the driver on
at most ``sample`` labelled rows (those of least id hash); a part of them, never
trained on, sets the temperature that divides the logit.

What the driver holds is fixed by parameters: the word vectors
(``VOCABULARY`` x 2 x ``DIM`` floats) and the sample's document vectors.

Defined cases: a null or empty text has the zero vector and is scored like any
other; labels with a null id or quality are left out, repeated labels each
count; without labels of both kinds the score is their mean (0.5 without any);
repeated rows get equal scores; a null id is held out; other columns are
ignored by ``score`` and kept by ``keep_good``; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import BYTE_VALUES, chunks, fmix, prefix, span_hash, utf8

VOCABULARY, DIM, NONZERO, WINDOW = 1 << 14, 48, 4, 2
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 60, 20
THRESHOLD, FOLDS = 0.3, 5
CHUNK = 512 << 10
BLOCK = 256  # buckets in a shuffled row of partial sums

# Classes of bytes: 0 white space, 1 letters, 2 digits, 3 other signs.
CLASS = np.full(256, 3, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
CLASS[0x30:0x3A] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of a chunk, in order, and the rows' offsets."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    kind = CLASS[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    s = np.flatnonzero(edge)
    e = np.append(s[1:], len(data))
    ink = kind[s] > 0
    s, e = s[ink], e[ink]
    h = span_hash(prefix(BYTE_VALUES[LOWER[data]]), s, e)
    upper = np.r_[0, np.cumsum(UPPER[data])]
    letters = kind[s] == 1
    n_upper = upper[e] - upper[s]
    shape = np.where(n_upper == 0, 0, np.where((n_upper == 1) & (UPPER[data[s]] == 1) & (e - s > 1), 1, np.where(n_upper == e - s, 2, 3)))
    both = np.empty((len(s), 2), np.int64)
    both[:, 0] = h % np.uint64(VOCABULARY)
    both[:, 1] = fmix(shape.astype(np.uint64) + np.uint64(1)) % np.uint64(VOCABULARY)
    use = np.ones((len(s), 2), bool)
    use[:, 1] = letters
    flat = both[use]
    per = np.r_[0, np.cumsum(1 + letters)]
    return flat, per[np.searchsorted(s, offs, "left")]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (VOCABULARY, NONZERO)), rng.choice([-1.0, 1.0], (VOCABULARY, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vector of each bucket from all texts: normalised context sums beside the index vector."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(VOCABULARY * DIM)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for lo, hi in chunks(offs, CHUNK):
                token, toff = buckets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                row = np.repeat(np.arange(hi - lo), np.diff(toff))
                for step in range(1, WINDOW + 1):
                    near = row[step:] == row[:-step]
                    a, b = token[:-step][near], token[step:][near]
                    # pairs are counted first: common ones repeat
                    pair, n = np.unique(a * VOCABULARY + b, return_counts=True)
                    a, b = pair // VOCABULARY, pair % VOCABULARY
                    for u, v in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(u * DIM + place[v, k], sign[v, k] * n, VOCABULARY * DIM)
        blocks = total.reshape(-1, BLOCK * DIM)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)),
                                              pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, np.float64) for b in table["sums"].to_pylist())
        return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    context = np.zeros((VOCABULARY // BLOCK, BLOCK * DIM))
    ddl = "block int, sums binary"
    for r in docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(scan, ddl).groupBy("block").applyInArrow(add, ddl).collect():
        context[r["block"]] = np.frombuffer(r["sums"], np.float64)
    context = context.reshape(VOCABULARY, DIM)
    context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    place, sign = index_vectors()
    own = np.zeros((VOCABULARY, DIM))
    np.add.at(own, (np.arange(VOCABULARY)[:, None], place), sign / NONZERO ** 0.5)
    return np.hstack([context, own]).astype(np.float32)


def document_vectors(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled vector of each row of a chunk."""
    token, toff = buckets(data, offs)
    n = np.diff(toff)
    out = np.zeros((len(n), vectors.shape[1] + 2), np.float32)
    rows = np.flatnonzero(n)
    if len(rows):
        # a token that a row repeats is weighted, not added again and again
        pair, times = np.unique(np.repeat(np.arange(len(n)), n) * VOCABULARY + token, return_counts=True)
        at = np.searchsorted(pair, rows * VOCABULARY)
        out[rows, :-2] = np.add.reduceat(vectors[pair % VOCABULARY] * times[:, None].astype(np.float32), at, axis=0) / n[rows, None]
        out[rows, -2] = np.log1p(n[rows]) / 8
        out[rows, -1] = np.diff(np.append(at, len(pair))) / n[rows]
    return out


@dataclass
class Network:
    """Two-layer network on standardised document vectors."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss with weight decay; one row in five sets the temperature."""
    rng = np.random.default_rng(SEED)
    width = vectors.shape[1] + 2
    rate = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        odds = np.clip(rate, 1e-3, 1 - 1e-3)
        return Network(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1),
                       float(np.log(odds / (1 - odds))), 1.0)
    order = rng.permutation(len(y))
    tuned = order[:len(y) // 5] if len(y) >= 50 else order
    train = order[len(y) // 5:] if len(y) >= 50 else order
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    z, t = (x[train] - mean) / scale, y[train]
    params = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN),
              np.array(np.log(t.mean() / (1 - t.mean())) if 0 < t.mean() < 1 else 0.0)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        pace = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        for part in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            w1, b1, w2, b2 = params
            hidden = np.maximum(z[part] @ w1 + b1, 0)
            error = (_sigmoid(hidden @ w2 + b2) - t[part]) / len(part)
            back = np.outer(error, w2) * (hidden > 0)
            grads = [z[part].T @ back + 1e-3 * w1, back.sum(0), hidden.T @ error + 1e-3 * w2, error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - pace * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    model = Network(vectors, mean, scale, params[0], params[1], params[2], float(params[3]), 1.0)
    logit, best = model.logit(x[tuned]), np.inf
    for temperature in np.geomspace(0.25, 8, 60):
        p = np.clip(_sigmoid(logit / temperature), 1e-7, 1 - 1e-7)
        loss = -np.mean(y[tuned] * np.log(p) + (1 - y[tuned]) * np.log(1 - p))
        if loss < best:
            best, model.temperature = loss, float(temperature)
    return model


def held_out(id_col):
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by ``FOLDS``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Network:
    """Fits the classifier: word vectors on all of ``docs``, the network on at
    most ``sample`` labelled rows that aren't held out."""
    vectors = word_vectors(docs, text_col)
    known = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isNotNull()).where(~held_out("_id"))
             .orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample))
    rows = (docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
            .join(F.broadcast(known), "_id"))  # at most ``sample`` rows
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for lo, hi in chunks(offs, CHUNK):
                x = document_vectors(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                                                  pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "y", "x"])

    got = rows.select(F.xxhash64("_id").alias("id"), "_text", "_y").mapInArrow(scan, "id long, y double, x binary").collect()
    got.sort(key=lambda r: (r["id"], r["y"], r["x"]))  # the same fit whatever the order of the tasks
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(len(got), vectors.shape[1] + 2)
    return fit(vectors, x, np.array([r["y"] for r in got]))


def _scores(batch_text, model: Network) -> np.ndarray:
    data, offs = utf8(batch_text)
    out = [model.probability(document_vectors(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], model.vectors))
           for lo, hi in chunks(offs, CHUNK)]
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score`` for each row of ``docs``; the score reads the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_scores(batch.column(2), shared.value))],
                                             names=["doc_id", "held_out", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(f"`{id_col}`").alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(text: pd.Series) -> pd.Series:
        return pd.Series(_scores(pa.array(text, pa.string(), from_pandas=True), shared.value))

    return docs.where(score_of(F.col(f"`{text_col}`").cast("string")) >= threshold)
