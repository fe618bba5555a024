"""Helpers shared by the operators of this subpackage.

Word rules, 64-bit word and shingle hashes over Arrow string buffers, scratch
tables in the shared folder, and connected components over an edge table.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir

#: Rows and bytes handed to Python at once; long documents make small batches.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Bytes of text worked on at once inside a task (one longer document goes alone).
SLICE_BYTES = 1 << 20
#: Tables of up to SMALL_ROWS rows of a few numbers are written as files of about FILE_ROWS rows.
SMALL_ROWS = 500_000
FILE_ROWS = 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give the executors this package, and bound what one Arrow batch can hold
    whatever the length of the texts."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.realpath(tempfile.mkdtemp(prefix="riskloom-"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/riskloom_package", "zip", os.path.dirname(root),
                                                         os.path.basename(root)))
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside free their shuffle files as they end.

    Else the files stay until the driver happens to collect its garbage, which
    does not come more often where the shuffles are larger.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    This cuts the lineage and survives the loss of an executor; the folder is
    the one the cluster names in spark.checkpoint.dir.

    ``rows``: the most rows that ``df`` can have, where that is known.  A small
    table then meets in a few files, however many tasks make it: each file costs
    an executor a process or a request of its own (on a local file system one
    ``chmod`` for the file and one for its checksum).
    """
    spark = df.sparkSession
    if rows is not None and rows <= SMALL_ROWS:
        df = df.repartition(rows // FILE_ROWS + 1)
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 12))
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[k] = p
    return _powers


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column (null: empty text)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(col) else raw[:0], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes that together cover all rows."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words_of(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE,
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) rows: runs of bytes that are not ``outside`` (a table of 256; by
    default ``[^\\x20\\x09-\\x0D]+``).

    Returns the hash of each word, its first byte and end, and for each row the
    index of its first word (n_rows + 1 entries).
    """
    n, rows = len(raw), len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(rows + 1, np.int64)
    low = _LOWER[raw]
    inside = ~outside[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[-1] = False
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[low] * power[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, offsets)


_LANES = mix64(np.arange(11, 11 + 64, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles_of(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, the row of each and the word it starts at.

    A row of fewer than k words is one shingle of its whole sequence; a row
    without words has none.  Repeats are kept.
    """
    n, count = len(h), np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    left = first[1:][rows] - np.arange(n) if n else np.zeros(0, np.int64)
    size = np.minimum(count[rows], k)
    at = np.flatnonzero(left >= size)
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        use = size[at] > j
        s[use] += h[at[use] + j] * _LANES[j]
    return mix64(s + size[at].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), rows[at], at


def distinct_per_row(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, hash) pairs."""
    o = np.lexsort((s, row))
    s, row = s[o], row[o]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[keep], row[keep]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node.

    Alternating large-star and small-star rounds over an edge table that is
    written to the shared folder each round, until a round changes nothing.
    Every step is a grouped minimum and a join, so a hub of any degree is
    pre-aggregated and its rows may be split by the skew join.  ``rows``: the
    most edges there can be, where that is known.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct(), name, rows)

    def mark(d: DataFrame):
        r = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen = mark(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")) \
            .select("p.u", "p.v").where("u <> v").distinct()
        e = materialize(small, name, 2 * seen[0])       # two rows for an edge at most
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(roots.select("node", F.col("node").alias("component")))
