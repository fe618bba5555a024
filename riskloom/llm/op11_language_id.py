"""Language identification by the nearest of several centroids per language.

A text becomes one vector: its letters (A-Z lower-cased; every run of other
ASCII bytes is one space) give byte 1-, 2- and 3-grams, hashed into DIMS
dimensions; a dimension weighs (1 + ln tf) * idf, and the vector has length 1.

* idf comes from all training documents (rows with a lang whose
  crc32(doc_id as text) mod 4 is not 2): each task counts its documents per
  dimension, and a grouped sum adds the counts up.
* centroids: at most TRAIN_PER_LANG training documents of each language, those
  with the smallest hashes (a documented bound of the fit), are clustered by
  spherical k-means into CLUSTERS centroids, one task for each language.  The
  MAX_LANGS most frequent languages are learned; the model has at most
  MAX_LANGS * CLUSTERS * DIMS floats (64 MB) and is broadcast.
* prediction: the language of the centroid with the greatest cosine; ``score``
  is that cosine.  ``rejected`` is set where the text is further from its
  centroid than REJECT_QUANTILE of the training documents of that centroid are,
  or than REJECT_DISTANCE where that is more; the predicted language is given
  all the same, and ``accepted_lang`` has it only where it is not rejected.

Scoring is a map over whole texts without a shuffle.

Defined cases: a null text, or one without any letter (Unicode category L), is
`und` with score 0 and rejected; so is every text where no language was
learned.  Ties go to the smallest language value.  A null doc_id is not held
out; its row trains if it has a lang.  Repeated rows count as often as they
occur.  An empty table gives no rows.  Very long texts are one vector like any
other.  Columns of docs other than doc_id, text and lang are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import common as C

HELD_OUT_OF, HELD_OUT_AT = 4, 2
DIMS = 8192
CLUSTERS = 4
TRAIN_PER_LANG = 2000
MAX_LANGS = 500
ROUNDS = 15
REJECT_QUANTILE, REJECT_DISTANCE = 0.999, 0.5
UNKNOWN = "und"
#: Rows of one dense matrix of DIMS columns (8 MB of counts).
_ROWS = 256

_LETTER = np.zeros(256, np.uint8)
for _c in range(256):
    _LETTER[_c] = _c + 32 if 65 <= _c <= 90 else _c if 97 <= _c <= 122 or _c >= 128 else 32


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT_AT, F.lit(False))


def _bucket(code: np.ndarray, n: int) -> np.ndarray:
    """Dimension of an n-gram given as a number of 8 n bits."""
    h = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - (DIMS.bit_length() - 1))


def gram_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, DIMS) counts of the hashed n-grams of each row."""
    rows = len(off) - 1
    b = _LETTER[raw]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))
    if len(b) == 0:
        return np.zeros((rows, DIMS), np.int32)
    # One space before each row, and one in place of each run of spaces.
    keep = b != 32
    first = np.zeros(len(b), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    keep[1:] |= b[:-1] != 32
    keep &= ~first | (b != 32)
    b, row = b[keep].astype(np.uint32), row[keep]
    n = np.bincount(row, minlength=rows)
    lead = np.cumsum(n) - n                                  # a space stands before each row's first byte
    b, row = np.insert(b, lead, 32), np.insert(row, lead, np.arange(rows, dtype=np.int32))
    base = row.astype(np.int64) * DIMS
    at = [base + _bucket(b, 1)]
    two = b[:-1] << np.uint32(8) | b[1:]
    at.append((base[:-1] + _bucket(two, 2))[row[:-1] == row[1:]])
    if len(b) > 2:
        three = two[:-1] << np.uint32(8) | b[2:]
        at.append((base[:-2] + _bucket(three, 3))[row[:-2] == row[2:]])
    return np.bincount(np.concatenate(at), minlength=rows * DIMS).reshape(rows, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 of (1 + ln tf) * idf."""
    v = counts.astype(np.float32)
    np.log(v, out=v, where=counts > 0)
    v += counts > 0
    v *= idf
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(length, 1e-12)[:, None]


def _matrices(col: pa.Array):
    """(first row, counts) of a text column in pieces of at most _ROWS rows."""
    raw, off = C.string_buffers(col)
    for i, j in C.row_slices(off):
        for k in range(i, j, _ROWS):
            m = min(j, k + _ROWS)
            yield k, gram_counts(raw[off[k]:off[m]], off[k:m + 1] - off[k])


def _document_counts(batches):
    total, docs = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for _, c in _matrices(b.column("text")):
            total += (c > 0).sum(axis=0)
            docs += len(c)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total, docs).tolist()], pa.list_(pa.int64()))], names=["df"])


def idf_weights(train: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of each dimension, over all training documents."""
    rows = train.select("text").mapInArrow(_document_counts, "df array<long>") \
        .select(F.posexplode("df").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    n = np.zeros(DIMS + 1)
    for r in rows:
        n[r["k"]] = r["n"]
    return (np.log((1 + n[-1]) / (1 + n[:-1])) + 1).astype(np.float32)


def _sparse(idf):
    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("dims", pa.binary()), ("weights", pa.binary())])
        for b in batches:
            for i, c in _matrices(b.column("text")):
                v = vectors(c, idf.value)
                at = [np.flatnonzero(x) for x in v]
                yield pa.RecordBatch.from_arrays([
                    b.column("lang").slice(i, len(v)), b.column("order").slice(i, len(v)),
                    pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                    pa.array([x[a].tobytes() for x, a in zip(v, at)], pa.binary())], schema=schema)
    return run


def cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the centroid of each row.

    The first centre is the mean; each next one is the row furthest from its
    nearest centre, so the result depends on the rows' order alone.
    """
    mean = x.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-12)]
    best = x @ centres[0]
    while len(centres) < min(CLUSTERS, len(x)) and best.min() < 1 - 1e-6:
        centres.append(x[int(best.argmin())])
        best = np.maximum(best, x @ centres[-1])
    centre = np.array(centres, np.float32)
    own = np.zeros(len(x), int)
    for _ in range(ROUNDS):
        new = (x @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (new == k).any():
                m = x[new == k].sum(axis=0)
                centre[k] = m / max(np.linalg.norm(m), 1e-12)
        if (new == own).all():
            break
        own = new
    return centre, (x @ centre.T).argmax(axis=1)


def _centroids(key, table):
    table = table.sort_by([("order", "ascending"), ("dims", "ascending"), ("weights", "ascending")])
    x = np.zeros((table.num_rows, DIMS), np.float32)
    for r, (d, w) in enumerate(zip(table.column("dims").to_pylist(), table.column("weights").to_pylist())):
        x[r, np.frombuffer(d, np.uint16)] = np.frombuffer(w, np.float32)
    centre, own = cluster(x)
    far = 1 - (x * centre[own]).sum(axis=1)
    radius = [max(REJECT_DISTANCE, float(np.quantile(far[own == k], REJECT_QUANTILE))) if (own == k).any() else REJECT_DISTANCE
              for k in range(len(centre))]
    return pa.table([pa.array([key[0].as_py()] * len(centre)), pa.array([c.tobytes() for c in centre], pa.binary()),
                     pa.array(radius, pa.float64())], names=["lang", "centroid", "radius"])


class CentroidModel:
    """Centroids of all languages, ordered by language, with the idf weights they were made with."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[str, bytes, float]]):
        rows = sorted(rows)
        self.idf = idf
        self.langs = [r[0] for r in rows]
        self.centroids = np.array([np.frombuffer(r[1], np.float32) for r in rows], np.float32).reshape(len(rows), DIMS)
        self.radius = np.array([r[2] for r in rows])

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and cosine of each row."""
        cos = vectors(counts, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)


def train(docs: DataFrame) -> CentroidModel:
    """The model learned from the documents that are not held out and have a lang."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .where(~held_out(F.col("doc_id"))).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return CentroidModel(np.ones(DIMS, np.float32), [])
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_weights(rows))
    # Twice the sample's share by hash first, so that the rank below sees a bounded number of rows.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * TRAIN_PER_LANG / r["n"] + 100 / r["n"])))])
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    picked = rows.withColumn("order", order).where(F.pmod("order", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    sample = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))) \
        .where(F.col("k") <= TRAIN_PER_LANG).select("lang", "order", "text")
    found = sample.mapInArrow(_sparse(idf), "lang string, order long, dims binary, weights binary") \
        .groupBy("lang").applyInArrow(_centroids, "lang string, centroid binary, radius double").collect()
    return CentroidModel(idf.value, [(r["lang"], bytes(r["centroid"]), r["radius"]) for r in found])


def _predict(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            n = b.num_rows
            best, score = np.zeros(n, int), np.zeros(n)
            for i, c in _matrices(b.column("text")):
                best[i:i + len(c)], score[i:i + len(c)] = model.nearest(c)
            ok = b.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            out = ~ok | (1 - score > model.radius[best])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"),
                pa.array([model.langs[k] if o else UNKNOWN for k, o in zip(best.tolist(), ok.tolist())]),
                pa.array(np.where(ok, score, 0.0)), pa.array(out),
                pa.array([None if o else model.langs[k] for k, o in zip(best.tolist(), out.tolist())], pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected", "accepted_lang"])
    return run


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, accepted_lang of every row."""
    spark = docs.sparkSession
    C.prepare(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                      F.col("text").cast("string").alias("text"))
    src = src.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if not model.langs:
        return src.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                          F.lit(True).alias("rejected"), F.lit(None).cast("string").alias("accepted_lang"))
    return src.mapInArrow(_predict(spark.sparkContext.broadcast(model)),
                          "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, accepted_lang string")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` (doc_id, text, lang) and predict every row of it."""
    C.prepare(docs.sparkSession)
    return identify(docs, train(docs))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(C.load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
