"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that together cover the whole
document.  Learned byte embeddings go through learned filters (WIDTH bytes,
every STRIDE bytes), a rectifier and a maximum over the chunk; a linear layer
turns the pooled features and the chunk's filled share (log scale) into its
logit.  A document's probability
comes from the mean and the minimum of its chunks' logits, weighted by two
learned numbers.

Training is bounded: at most TRAIN_PER_CLASS labelled documents of each class
(smallest hash of doc_id first), outside the held-out fold, with at most
TRAIN_CHUNKS chunks of each, spread over the whole document.  Scoring covers
every byte of every document.  Only the text is an input of a score.

Defined cases: a null or empty text is one chunk of padding and gets that
chunk's probability.  A text of any length is scored whole.  Equal texts have
equal scores.  Documents that occur several times in labels are trained on
once.  Without labelled rows of both classes every document gets the share of
label 1 among the labelled rows (1.0 without any).  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

CHUNK, STEP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 8, 32
TRAIN_PER_CLASS = 2000
TRAIN_CHUNKS = 4
EPOCHS = 6
THRESHOLD = 0.3
FOLDS = 5
_WINDOWS = (CHUNK - WIDTH) // STRIDE + 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def chunk_matrix(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all rows as a padded matrix (0 is padding), and the row of each."""
    size = np.diff(off)
    n = np.maximum(1, -(-np.maximum(size - (CHUNK - STEP), 0) // STEP))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start, end = off[row] + k * STEP, off[row + 1]
    padded = np.concatenate((raw, np.zeros(CHUNK, np.uint8)))
    at = np.minimum(start, len(raw))[:, None] + np.arange(CHUNK)
    return np.where(at < end[:, None], padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8), row


class Network:
    """Parameters, forward pass and gradient; everything is float32."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
                  "bias": np.zeros(FILTERS), "out": rng.normal(0, FILTERS ** -0.5, FILTERS), "fill": np.zeros(2), "shift": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.mix = np.array([1.0, 0.0, 0.0], np.float32)     # of the mean logit, the least logit, 1

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x].reshape(len(x), CHUNK * EMBED)
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
        return np.ascontiguousarray(w).reshape(len(x) * _WINDOWS, WIDTH * EMBED)

    @staticmethod
    def _filled(x: np.ndarray) -> np.ndarray:
        """Filled share of each chunk on a log scale, and its square: short texts excite few filters."""
        u = np.log2(np.maximum((x != 0).sum(axis=1), 1) / CHUNK).astype(np.float32) / 9
        return np.stack([u, u * u], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.float32)
        for i in range(0, len(x), 128):
            part = x[i:i + 128]
            a = (self._columns(part) @ self.p["filters"]).reshape(len(part), _WINDOWS, FILTERS).max(axis=1)
            out[i:i + 128] = np.maximum(a + self.p["bias"], 0) @ self.p["out"] \
                + self._filled(part) @ self.p["fill"] + self.p["shift"]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        cols = self._columns(x)
        a = (cols @ self.p["filters"]).reshape(len(x), _WINDOWS, FILTERS)
        best = a.argmax(axis=1)
        top = np.take_along_axis(a, best[:, None, :], axis=1)[:, 0] + self.p["bias"]
        pooled = np.maximum(top, 0)
        filled = self._filled(x)
        z = pooled @ self.p["out"] + filled @ self.p["fill"] + self.p["shift"]
        d = ((1 / (1 + np.exp(-z)) - y) * weight / weight.sum()).astype(np.float32)
        back = d[:, None] * self.p["out"] * (top > 0)
        # Only the window that gave the maximum of a filter has a gradient.
        windows = cols.reshape(len(x), _WINDOWS, WIDTH * EMBED)[np.arange(len(x))[:, None], best]
        g = {"out": pooled.T @ d, "fill": filled.T @ d, "shift": d.sum(keepdims=True), "bias": back.sum(0),
             "filters": np.einsum("nf,nfk->kf", back, windows)}
        into = (back[:, :, None] * self.p["filters"].T).reshape(len(x), FILTERS, WIDTH, EMBED)
        bytes_at = x[np.arange(len(x))[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], bytes_at.ravel(), into.reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7, rate: float = 0.01) -> None:
        """Adam over shuffled batches; both classes weigh the same.  In each epoch a quarter
        of the chunks is cut to a random shorter length, as short documents are rare."""
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            keep = np.where(rng.random(len(x)) < 0.25, np.exp(rng.uniform(np.log(12), np.log(CHUNK), len(x))), CHUNK)
            cropped = np.where(np.arange(CHUNK) < keep[:, None], x, 0).astype(np.uint8)
            for i in range(0, len(x), 64):
                b = order[i:i + 64]
                t += 1
                for k, g in self.gradient(cropped[b], y[b], weight[b]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = rate * (1 - epoch / EPOCHS * 0.8) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-7)
                    self.p[k] = (self.p[k] - step).astype(np.float32)

    def summary(self, logit: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Mean logit, least logit and 1 for each document."""
        count = np.bincount(row, minlength=n)
        least = np.full(n, np.inf)
        np.minimum.at(least, row, logit)
        return np.stack([np.bincount(row, logit, n) / count, least, np.ones(n)], axis=1)

    def fit_mix(self, s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))
            h = (s * (weight * p * (1 - p))[:, None]).T @ s + 1e-2 * np.eye(3)
            step = np.linalg.solve(h, s.T @ (weight * (y - p)) - 1e-2 * w)
            w += np.clip(step, -2, 2)
        self.mix = w.astype(np.float32)

    def probability(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each row, from all of its chunks."""
        out = []
        for i, j in C.row_slices(off, 1 << 18):
            x, row = chunk_matrix(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            s = self.summary(self.logits(x), row, j - i)
            out.append(1 / (1 + np.exp(-np.clip(s @ self.mix, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def _training_chunks(batches):
    """(doc_id, label, chunk) for at most TRAIN_CHUNKS chunks of a document, spread evenly."""
    for b in batches:
        raw, off = C.string_buffers(b.column("text"))
        ids, labels = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
        out = [[], [], []]
        for i, j in C.row_slices(off, 1 << 18):
            x, row = chunk_matrix(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            for r in range(j - i):
                lo, hi = np.searchsorted(row, [r, r + 1])
                for k in np.unique(np.linspace(lo, hi - 1, TRAIN_CHUNKS).astype(int)):
                    for col, v in zip(out, (ids[i + r], labels[i + r], x[k].tobytes())):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                                         names=["doc_id", "label", "chunk"])


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The fitted network, or the share of label 1 where one class is missing."""
    labelled = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return 1.0 if not n0 else 0.0
    parts = [labelled.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_CLASS) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))     # at most 2 * TRAIN_PER_CLASS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id") \
        .mapInArrow(_training_chunks, "doc_id long, label int, chunk binary").collect()
    if not {0, 1} <= {r["label"] for r in rows}:
        return n1 / (n0 + n1)
    rows.sort(key=lambda r: (r["doc_id"], r["chunk"]))
    x = np.frombuffer(b"".join(bytes(r["chunk"]) for r in rows), np.uint8).reshape(-1, CHUNK)
    y = np.array([r["label"] for r in rows], np.float32)
    net = Network()
    net.fit(x, y)
    _, row = np.unique([r["doc_id"] for r in rows], return_inverse=True)
    s = net.summary(net.logits(x), row, row.max() + 1)
    label = np.zeros(len(s))
    label[row] = y
    # Back to the classes' shares among the labelled rows.
    net.fit_mix(s, label, np.where(label > 0, n1 / label.sum(), n0 / (len(label) - label.sum())) * len(label) / (n0 + n1))
    return net


def score(docs: DataFrame, net: Network | float, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of label 1 (a column of that name is replaced)."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    C.prepare(docs.sparkSession)
    if isinstance(net, float):
        return docs.withColumn(out, F.lit(net))

    def run(batches):
        for b in batches:
            raw, off = C.string_buffers(b.column("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.probability(raw, off).astype(np.float64))],
                                             names=[*b.schema.names, out])

    kept = docs.drop(out)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns as they were."""
    C.prepare(docs.sparkSession)
    name = "_" * (1 + max(map(len, docs.columns))) + "score"       # no column of docs is called so
    return score(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs``, score and predicted (1 where score >= THRESHOLD)."""
    C.prepare(docs.sparkSession)
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, C.load(spark, sf_dir, "labels")) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
