"""Ranked lexical search over a K2-treap of the term-document grid.

Rows of the grid are the terms that the items ask for, columns are documents;
a cell holds the impact of its term in its document,
w * ((10^9 tf) div (1000 tf + 20 m)), in whole numbers.  A K2-treap halves rows
and columns at once: a node's four quadrants are one nibble (which of them are
not empty), children follow each other in level order, so a nibble and a running
count of children replace all pointers, and each node keeps the greatest impact
below it.

Search of one item: its terms' row paths descend together.  A state is a range
of documents with one node for each term; the sum of the nodes' maxima bounds
every document of the range.  The states with the greatest bounds are halved
first; a range that cannot reach the 50th best score found so far is never
opened.  At a single document the sum is its exact score.

On Spark:

1. one scan writes each document's length and its counts of the asked terms;
2. df of the asked terms, N and L are sums over that table;
3. a second map builds a treap for each BLOCK_DOCS documents (or BLOCK_CELLS
   cells), searches all items in it, and carries each item's 50 best (and so the
   bound) from block to block of a task;
4. a rank over the tasks' best, cut before the shuffle by Spark's group limit.

Items are taken in blocks of ITEM_BYTES of text, each broadcast.  Terms are told
apart by 64-bit hashes.

Defined cases: a null text has no term; an item or document without terms is in
no result.  Rows with the same item_id and text are one item; different texts
under one item_id are separate items, each with its own ranks.  A row of
documents is a document, repeated or not; a null doc_id comes after all others
on equal scores.  Empty tables give no rows.  Only the columns doc_id, item_id
and text are read.  Very long texts are counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import common as C

TOP = 50
ITEM_BYTES = 4 << 20
BLOCK_DOCS, BLOCK_CELLS = 16384, 3_000_000
#: States opened at once at first; the number doubles up to the last value.
OPEN_FIRST, OPEN_MOST = 16, 1024

#: Bytes outside of terms ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
_OUTSIDE = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _OUTSIDE[_lo:_hi + 1] = False

_NULL_ID = np.iinfo(np.int64).max           # stands for a null doc_id inside a block


def _terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term, and for each row the index of its first term."""
    h, _, _, first = C.words_of(raw, off, _OUTSIDE)
    return h, first


class Items:
    """A block of items: ids, the distinct asked terms and each item's terms as their numbers."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids, own = [], []
        for item_id, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            h = np.unique(_terms(raw, np.array([0, len(raw)]))[0])
            if len(h):
                self.ids.append(item_id)
                own.append(h)
        self.vocab = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocab, h) for h in own]


def item_blocks(items: DataFrame):
    """Blocks of items, about ITEM_BYTES of text in each."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null").distinct()
    n = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES) + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        block = Items(sorted(((r["item_id"], r["text"]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if block.ids:
            yield block


# --- counts of asked terms -------------------------------------------------------

_COUNT_FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())]
_COUNT_DDL = "doc_id long, n long, terms binary, tf binary"


def _counts(vocab):
    def run(batches):
        asked = vocab.value
        for b in batches:
            raw, off = C.string_buffers(b.column("text"))
            for i, j in C.row_slices(off):
                h, first = _terms(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.diff(first)
                row = np.repeat(np.arange(j - i), n)
                at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                hit = asked[at] == h
                key, tf = np.unique(row[hit] * len(asked) + at[hit], return_counts=True)
                row, term, tf = key // len(asked), (key % len(asked)).astype(np.uint32), tf.astype(np.uint32)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)),
                    pa.array([term[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                    pa.array([tf[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], schema=pa.schema(_COUNT_FIELDS))
    return run


def _document_counts(n_terms: int):
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for t in b.column("terms"):
                df[np.frombuffer(t.as_buffer(), np.uint32)] += 1
        at = np.flatnonzero(df)
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[part])], names=["term", "df"])
    return run


# --- the treap ---------------------------------------------------------------------

_SIZE = np.array([bin(x).count("1") for x in range(16)], np.int64)
#: _BEFORE[4 * nibble + q]: children before quadrant q, or -1 where it is empty.
_BEFORE = np.array([bin(x & ((1 << q) - 1)).count("1") if x >> q & 1 else -1 for x in range(16) for q in range(4)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x at even places (32 bits to 64)."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """K2-treap of (row, column, impact) cells with impacts above 0; rows and columns below 2^height.

    Nodes of all levels stand one after the other, the root at 0.  ``most``:
    greatest impact below a node; ``child`` and ``nibble`` give its children.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray, height: int):
        self.height = height
        code = _spread(row) << np.uint64(1) | _spread(col)
        order = np.argsort(code)
        code, most = code[order], impact[order]
        levels = [(most, np.zeros(len(code), np.uint8))]
        for _ in range(height):
            up = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1]))) if len(up) else np.zeros(0, int)
            bit = (1 << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            most = np.maximum.reduceat(most, start) if len(start) else most
            levels.append((most, np.bitwise_or.reduceat(bit, start) if len(start) else bit))
            code = up[start]
        levels.reverse()
        # Node 0 of a treap without cells is missing; one empty node at the end stands for every missing child.
        self.nibble = np.concatenate([x[1] for x in levels] + [np.zeros(1, np.uint8)]).astype(np.int64)
        self.most = np.concatenate([x[0] for x in levels] + [np.zeros(1, np.int64)])
        self.none = len(self.most) - 1
        sizes = _SIZE[self.nibble]
        self.child = np.cumsum(sizes) - sizes + 1           # level order: the root is 0, its first child 1

    def children(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        before = _BEFORE[4 * self.nibble[node] + quadrant]
        return np.where(before < 0, self.none, self.child[node] + before)


def search(treap: Treap, rows: np.ndarray, ids: np.ndarray, top: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` best (scores, doc ids) of ``best`` and the treap's documents for the rows of one item.

    ``ids``: ascending id of each column.  ``best`` is in rank order.
    """
    scores, docs = best
    n_cols = len(ids)
    if treap.none == 0:
        return best
    node = np.zeros((1, len(rows)), np.int64)
    bound, depth, col = np.array([treap.most[0] * len(rows)]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    opened = OPEN_FIRST
    while len(bound):
        if len(scores) == top:
            # A range whose bound only equals the last rank matters if an id in it is smaller.
            keep = (bound > scores[-1]) | ((bound == scores[-1]) & (ids[col << (treap.height - depth)] < docs[-1]))
            bound, depth, col, node = bound[keep], depth[keep], col[keep], node[keep]
            if not len(bound):
                break
        if len(bound) > opened:
            pick = np.argpartition(bound, len(bound) - opened)[len(bound) - opened:]
        else:
            pick = np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[pick] = False
        opened = min(2 * opened, OPEN_MOST)
        d, c, at = depth[pick], col[pick], node[pick]
        down = 2 * (rows[None, :] >> (treap.height - 1 - d)[:, None] & 1)
        new = np.concatenate([treap.children(at, down), treap.children(at, down + 1)])
        d, c = np.concatenate([d, d]) + 1, np.concatenate([2 * c, 2 * c + 1])
        b = treap.most[new].sum(axis=1)
        live = (b > 0) & (c << (treap.height - d) < n_cols)
        leaf = live & (d == treap.height)
        if leaf.any():
            scores, docs = np.concatenate([scores, b[leaf]]), np.concatenate([docs, ids[c[leaf]]])
            order = np.lexsort((docs, -scores))[:top]
            scores, docs = scores[order], docs[order]
        live &= ~leaf
        bound, depth, col = (np.concatenate([x[rest], y[live]]) for x, y in ((bound, b), (depth, d), (col, c)))
        node = np.concatenate([node[rest], new[live]])
    return scores, docs


class Weights:
    """What a search needs besides the documents' counts."""

    def __init__(self, items: Items, df: np.ndarray, n_docs: int, n_terms: int):
        # Rows by falling df, so that cells gather terms of like weight and the maxima stay tight.
        order = np.lexsort((np.arange(len(df)), -df))
        self.row = np.empty(len(df), np.int64)
        self.row[order] = np.arange(len(df))
        w = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.weight, self.n_docs, self.n_terms = w, n_docs, n_terms
        self.ids, self.rows = items.ids, [np.sort(self.row[t]) for t in items.terms]

    def impact(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 50 + 50 * n * self.n_docs // self.n_terms
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _search(shared, top: int):
    def run(batches):
        x = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(x.ids)
        held, cells, docs = [], 0, 0

        def block():
            """The held documents (a piece of a batch each) as one treap, searched for every item."""
            ids, n, size, term, tf = (np.concatenate([h[k] for h in held]) for k in range(5))
            col = np.empty(len(ids), np.int64)
            order = np.argsort(ids, kind="stable")
            col[order] = np.arange(len(ids))
            doc = np.repeat(np.arange(len(ids)), size)
            impact = x.impact(term, tf, n[doc])
            use = impact > 0
            height = int(max(len(x.row) - 1, len(ids) - 1, 1)).bit_length()
            treap = Treap(x.row[term[use]], col[doc[use]], impact[use], height)
            del term, tf, doc, impact
            for k, rows in enumerate(x.rows):
                best[k] = search(treap, rows, ids[order], top, best[k])

        for b in batches:
            ids = b.column("doc_id").fill_null(_NULL_ID).to_numpy()
            n = b.column("n").to_numpy()
            terms, tfs = b.column("terms"), b.column("tf")
            size = np.array([len(t.as_buffer()) // 4 for t in terms], np.int64)
            i = 0
            while i < len(ids):
                j = i + 1 + int(np.searchsorted(np.cumsum(size[i:]), max(BLOCK_CELLS - cells, 0)))
                j = min(len(ids), j, i + BLOCK_DOCS - docs)
                held.append((ids[i:j], n[i:j], size[i:j],
                             *(np.frombuffer(b"".join(v.as_py() for v in part.slice(i, j - i)), np.uint32).astype(np.int64)
                               for part in (terms, tfs))))
                cells, docs, i = cells + int(size[i:j].sum()), docs + j - i, j
                if docs >= BLOCK_DOCS or cells >= BLOCK_CELLS:
                    block()
                    held, cells, docs = [], 0, 0
        if held:
            block()
        for k, (scores, found) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array([k] * len(scores), pa.int32()), pa.array([x.ids[k]] * len(scores), pa.int64()),
                    pa.array(found, mask=found == _NULL_ID), pa.array(scores)], names=["item", "item_id", "doc_id", "score"])
    return run


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of each item."""
    spark = docs.sparkSession
    C.prepare(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        counts = C.materialize(src.mapInArrow(_counts(spark.sparkContext.broadcast(block.vocab)), _COUNT_DDL), "op12-counts")
        sums = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not sums["docs"]:
            break
        df = np.zeros(len(block.vocab), np.int64)
        rows = counts.select("terms").mapInArrow(_document_counts(len(df)), "term long, df long") \
            .groupBy("term").agg(F.sum("df").alias("df")).collect()      # as many rows as the block's terms
        df[[r["term"] for r in rows]] = [r["df"] for r in rows]
        shared = spark.sparkContext.broadcast(Weights(block, df, sums["docs"], sums["terms"]))
        found = counts.mapInArrow(_search(shared, top), "item int, item_id long, doc_id long, score long")
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top) \
            .select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))
