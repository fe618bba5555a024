"""Benchmark decontamination by SimHash of item-sized windows.

Items and documents are words (letters, digits and non-ASCII, A-Z lower-cased)
and 5-word shingles.  For each item that shares shingles with a document, windows
of that item's length are laid wherever enough shared shingles lie inside one to
reach the similarity, in whatever order they stand; all other windows are below
it.  Those with the most shared shingles come first, and the rest are left when
they cannot be better than what was found.  Each window's 64-bit SimHash (shingles vote with their counts) is looked up in
a multi-index: RADIUS + 1 blocks of bits guarantee that every item fingerprint
within RADIUS is found.  Candidates are verified by the exact weighted shingle
similarity, sum of minimum over sum of maximum counts, of 0.8 or more.

RADIUS 20 of 64 bits: shingle multisets of similarity 0.8 differ in 9.7 bits on
average with a standard deviation of 2.9.

Items are a stated query set: they are broadcast in blocks of at most
ITEM_BYTES bytes of text, and each block passes over all documents.  Documents
are never shuffled.

Result: one row for each document and item that match, with the best window.
Defined cases: null or empty items and documents match nothing; items of fewer
than five words match their exact word sequence; repeated rows match each.  Equal
similarities keep the first window.  A null doc_id is kept.  Empty tables give
no rows.  Very long texts are searched whole.  Only doc_id, item_id and text are
read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

K = 5
RADIUS = 20
SIMILARITY = 0.8
ITEM_BYTES = 16 << 20
_FILTER_BITS = 20

_TO_WORD = np.full(256, 0x20, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TO_WORD[_a:_b] = np.arange(_a, _b)


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """Start and width of radius + 1 blocks that cover 64 bits."""
    cut = np.linspace(0, 64, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cut, cut[1:])]


def simhash(s: np.ndarray) -> int:
    """64-bit SimHash of a multiset of shingle hashes."""
    votes = np.unpackbits(np.ascontiguousarray(C.mix64(s)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(s), bitorder="little").view(np.uint64)[0])


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minimum over sum of maximum counts of two (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class ItemIndex:
    """Items by shingle, by length and by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.radius, self.blocks = radius, block_bounds(radius)
        self.ids, self.length, self.sets, prints = [], [], [], []
        keys, owners, places = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            raw = _TO_WORD[np.frombuffer((text or "").encode(), np.uint8)]
            h, _, _, first = C.words_of(raw, np.array([0, len(raw)]))
            if not len(h):
                continue
            s, _, at = C.shingles_of(h, first, K)
            if len(h) < K:
                self.short.setdefault(len(h), {}).setdefault(int(s[0]), []).append(item_id)
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.length.append(len(h))
            self.sets.append(np.unique(s, return_counts=True))
            prints.append(simhash(s))
            keys.append(s)
            owners.append(np.full(len(s), k))
            places.append(at)
        self.prints = np.array(prints, np.uint64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner = np.concatenate(owners)[order] if keys else np.zeros(0, int)
        self.place = np.concatenate(places)[order] if keys else np.zeros(0, int)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.key & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.tables = []
        for start, width in self.blocks:
            part = (self.prints >> np.uint64(start)) & np.uint64((1 << width) - 1)
            self.tables.append({int(v): np.flatnonzero(part == v) for v in np.unique(part)})

    def within(self, fp: int) -> np.ndarray:
        """All items whose fingerprint is within the radius."""
        found = [t[v] for (start, width), t in zip(self.blocks, self.tables) if (v := fp >> start & (1 << width) - 1) in t]
        if not found:
            return np.zeros(0, int)
        c = np.unique(np.concatenate(found))
        return c[np.bitwise_count(self.prints[c] ^ np.uint64(fp)) <= self.radius]

    def shared(self, s: np.ndarray, near: np.ndarray):
        """(item, ascending places of a document that hold one of its shingles) for each item touched."""
        lo, hi = np.searchsorted(self.key, s[near], "left"), np.searchsorted(self.key, s[near], "right")
        n = hi - lo
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.stack([self.owner[entry], np.repeat(near, n)], axis=1), axis=0)
        cut = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))) if len(pairs) else np.zeros(0, int)
        for i, j in zip(cut, np.append(cut[1:], len(pairs))):
            yield int(pairs[i, 0]), pairs[i:j, 1]

    def windows(self, item: int, places: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(starts, shared places inside, words) of the windows that can reach the similarity, most shared places first."""
        words = min(self.length[item], n_words)
        size = max(1, words - K + 1)
        need = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (size + self.length[item] - K + 1) - 1e-9))
        if len(places) < need:
            return np.zeros(0, int), np.zeros(0, int), words
        start = np.arange(max(0, int(places[need - 1]) - size + 1), min(n_words - words, int(places[-need])) + 1)
        count = np.searchsorted(places, start + size) - np.searchsorted(places, start)
        start, count = start[count >= need], count[count >= need]
        order = np.lexsort((start, -count))
        return start[order], count[order], words

    def matches(self, s: np.ndarray, n_words: int, near: np.ndarray) -> dict[int, tuple]:
        """Best (similarity, first word, words, distance) for each item found in a document.

        ``s``: the shingle at each word but the last four; ``near``: the places that may hold a shared one.
        """
        best: dict[int, tuple] = {}
        looked: dict[tuple[int, int], tuple] = {}       # windows: fingerprint, items within the radius, shingles with counts
        for k, places in self.shared(s, near):
            found, most = None, -1
            starts, counts, words = self.windows(k, places, n_words)
            for start, count in zip(starts.tolist(), counts.tolist()):
                if count < most:
                    break
                if (start, words) not in looked:
                    window = s[start:start + max(1, words - K + 1)]
                    fp = simhash(window)
                    looked[start, words] = (fp, set(self.within(fp).tolist()), np.unique(window, return_counts=True))
                fp, close, own = looked[start, words]
                if k in close:
                    sim = weighted_similarity(own, self.sets[k])
                    if sim >= SIMILARITY and (found is None or sim > found[0] or sim == found[0] and start < found[1]):
                        found = (sim, start, words, (int(self.prints[k]) ^ fp).bit_count())
                        total = int(own[1].sum() + self.sets[k][1].sum())
                        most = round(sim * total / (1 + sim))           # shared shingles by count
            if found and (self.ids[k] not in best or found[0] > best[self.ids[k]][0]):
                best[self.ids[k]] = found
        return best


_DDL = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"


def _found(index: ItemIndex, text: pa.Array):
    """(row, item, similarity, first word, words, distance) of all matches in a column of texts."""
    raw, off = C.string_buffers(text)
    for i, j in C.row_slices(off):
        h, _, _, first = C.words_of(_TO_WORD[raw[off[i]:off[j]]], off[i:j + 1] - off[i])
        n = np.diff(first)
        s, row, at = C.shingles_of(h, first, K)
        hit = index.maybe[s & np.uint64((1 << _FILTER_BITS) - 1)]
        hit[hit] = np.isin(s[hit], index.key)
        for r in np.unique(row[hit]).tolist():
            if n[r] >= K:
                lo, hi = np.searchsorted(row, [r, r + 1])
                for item, v in sorted(index.matches(s[lo:hi], int(n[r]), np.flatnonzero(hit[lo:hi])).items()):
                    yield (i + r, item, *v)
        for k, table in index.short.items():
            s, row, at = C.shingles_of(h, first, k)
            use = (n[row] >= k) & np.isin(s, np.array(list(table), np.uint64))
            done = set()
            for key, r, p in zip(s[use].tolist(), row[use].tolist(), at[use].tolist()):
                for item in table[key]:
                    if (r, item) not in done:
                        done.add((r, item))
                        yield i + r, item, 1.0, p - int(first[r]), k, 0


def _search(shared):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[r], *v) for r, *v in _found(shared.value, b.column("text"))]
            kinds = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                     ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, (_, t) in enumerate(kinds)],
                                             names=[c for c, _ in kinds])
    return run


def _without(shared):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[x[0] for x in _found(shared.value, b.column("text").cast(pa.string()))]] = False
            yield b.filter(pa.array(keep))
    return run


def item_blocks(benchmark: DataFrame):
    """Broadcast indexes of blocks of items, about ITEM_BYTES of text in each."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sc.broadcast(ItemIndex(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows)))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, distance of all matches (a null item_id is -1)."""
    C.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in item_blocks(benchmark):
        part = src.mapInArrow(_search(shared), _DDL)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were, without a shuffle."""
    C.prepare(docs.sparkSession)
    for shared in item_blocks(benchmark):
        docs = docs.mapInArrow(_without(shared), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))
