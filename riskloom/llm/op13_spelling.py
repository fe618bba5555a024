"""Spelling variants of corpus words by search schemes on a bidirectional FM-index.

Words are counted over all texts, and two words are near when one inserted,
deleted or replaced code point makes one of the other.  A word's form is its
near word of largest count (ties: the smallest in code-point order) if that is
RATIO times its own or more; its root is where the forms lead.

Search scheme: one error leaves one half of a word whole.  So each vocabulary
word stands under its length with its left half, and under its length with its
right half; a word asks for the lengths one less, equal and one more with its
own first or last letters.  All rows of a key meet in one of n blocks (by hash):

* a block builds a bidirectional FM-index of its delimited words
  (``|word|word|...|``): suffix ranks of the text and of its reverse, and a
  wavelet matrix over each transform.  A pattern is a pair of suffix-rank
  intervals that stay in step when it grows by a symbol on either side;
* a search matches the delimiter and the known half exactly, goes on across the
  other half with exactly one error of the kind that the asked length demands
  (a branch for each symbol that follows in the interval), and ends with the
  delimiter; the rank of the interval is the number of the word;
* of the ways to read one insertion or deletion in a run of equal letters only
  the leftmost counts, so every near word of every word is found exactly once in
  the whole search, and blocks can add up what they found.

A key that more than HOT_WORDS vocabulary words share is split: their unknown
half is halved again (the error is in one of the two), as often as needed, so
no key grows with the vocabulary and no words are compared pair by pair.

Roots are found by pointer doubling; counts rise RATIO-fold with every form, so
the rounds are few.

Defined cases: a null or empty text has no words; of rows with a null doc_id no
letter is deleted (there is no id to hash).  Repeated rows count as often as
they occur.  An empty table gives no rows.  Runs of any length are words; very
long texts are read in whole.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
EDIT_EVERY = 199
#: Symbols of the vocabulary in one block, on average, and words that may share a key.
BLOCK_SYMBOLS = 1_500_000
HOT_WORDS = 20_000
#: Distinct words a task counts before it hands them on; searches run at once in a block.
FLUSH_WORDS = 300_000
SEARCHES = 100_000

_OUTSIDE = np.ones(256, bool)
for _lo, _hi in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF)):
    _OUTSIDE[_lo:_hi + 1] = False

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> np.uint32(1) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


# --- words of the corpus -----------------------------------------------------------

def latin(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 rows as one byte a letter: A-Z, a-z and U+00C0-U+00FF as their code points, all else outside of words."""
    lead = raw == 0xC3
    after = np.zeros(len(raw), bool)
    after[1:] = lead[:-1]
    out = np.where(after, raw + np.uint8(0x40), np.where(raw < 0x80, raw, np.uint8(0x20)))
    keep = np.concatenate((np.zeros(1, np.int64), np.cumsum(~lead)))
    return out[~lead], keep[off]


def _crc(text: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of the UTF-8 form of lower-cased runs, continued from the crc32 ``seed`` of what stands before."""
    out = np.empty(len(start), np.uint32)
    size = end - start
    long = size > 64
    for k in np.flatnonzero(long):
        out[k] = zlib.crc32(text[start[k]:end[k]].tobytes().decode("latin-1").encode(), int(seed[k]))
    order = np.flatnonzero(~long)
    order = order[np.argsort(-size[order], kind="stable")]
    state = ~seed[order].astype(np.uint32)
    at, left = start[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))          # runs longer than j
        c, s = text[at[:n] + j], state[:n]
        two = np.flatnonzero(c >= 0x80)
        if len(two):
            s[two] = _CRC[(s[two] ^ np.uint32(0xC3)) & np.uint32(255)] ^ s[two] >> np.uint32(8)
            c[two] -= np.uint8(0x40)
        state[:n] = _CRC[(s ^ c) & np.uint32(255)] ^ s >> np.uint32(8)
    out[order] = ~state
    return out


def _count_words(batches):
    held: dict[str, int] = {}
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())],
                                           schema=schema)
        held.clear()
        return batch

    def add(word: str, n: int):
        held[word] = held.get(word, 0) + n

    for b in batches:
        raw, off = C.string_buffers(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        for i, j in C.row_slices(off):
            text, o = latin(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            h, start, end, first = C.words_of(text, o, _OUTSIDE)
            row = np.repeat(np.arange(i, j), np.diff(first))
            use = end - start >= MIN_LETTERS
            h, start, end, row = h[use], start[use], end[use], row[use]
            if not len(h):
                continue
            text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
            named = np.array([x is not None for x in ids[i:j]])[row - i]
            seeds = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[i:j]], np.uint32)[row - i]
            crc = _crc(text, start, end, seeds)
            edited = named & (crc % EDIT_EVERY == 0)
            for s, e, c in zip(start[edited].tolist(), end[edited].tolist(), crc[edited].tolist()):
                if e - s > MIN_LETTERS:
                    at = s + c % (e - s)
                    add((text[s:at].tobytes() + text[at + 1:e].tobytes()).decode("latin-1"), 1)
            _, at, n = np.unique(h[~edited], return_index=True, return_counts=True)
            start, end = start[~edited][at], end[~edited][at]
            for s, e, k in zip(start.tolist(), end.tolist(), n.tolist()):
                add(text[s:e].tobytes().decode("latin-1"), k)
            if len(held) >= FLUSH_WORDS:
                yield out()
    if held:
        yield out()


def corpus_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of ``docs`` of MIN_LETTERS or more that occur MIN_COUNT times or more."""
    C.prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- the index -----------------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a cyclic text by its next ``depth`` symbols or more (ties in any order)."""
    n = len(text)
    pos = np.arange(n)
    rank = np.zeros(n, np.uint64)
    for k in range(8):                                       # eight symbols at once
        rank = rank << np.uint64(8) | np.roll(text, -k).astype(np.uint64)
    known = 8
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        new = np.concatenate(([0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])))
        if known >= depth or new[-1] == n - 1:
            return order
        dense = np.empty(n, np.int64)
        dense[order] = new
        rank = dense.astype(np.uint64) * np.uint64(n) + dense[(pos + known) % n].astype(np.uint64)
        known *= 2


class WaveletMatrix:
    """Rank, and counts of smaller symbols, in ranges of a transform; symbols below 2^bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        n = len(symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << bits))))     # symbols smaller than c
        self.zeros, self.ones_at = [], []
        x = symbols
        for bit in range(bits - 1, -1, -1):
            one = (x >> bit & 1).astype(bool)
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append((bit, zeros))
            self.ones_at.append(int(zeros[-1]))
            x = np.concatenate((x[~one], x[one]))
        # Where each symbol's part starts on the last level.
        every = np.arange(1 << bits)
        self.base = np.zeros(1 << bits, np.int64)
        self.base = self._down(np.zeros(1 << bits, np.int64), every)

    def _down(self, at: np.ndarray, sym: np.ndarray) -> np.ndarray:
        for (bit, zeros), ones in zip(self.zeros, self.ones_at):
            z = zeros[at]
            at = np.where(sym >> bit & 1, ones + at - z, z)
        return at

    def step(self, lo: np.ndarray, size: np.ndarray, sym: np.ndarray):
        """(first rank, size, smaller symbols in the range) after one backward step over ``sym``."""
        hi, less = lo + size, np.zeros(len(lo), np.int64)
        for (bit, zeros), ones in zip(self.zeros, self.ones_at):
            one = (sym >> bit & 1).astype(bool)
            zl, zh = zeros[lo], zeros[hi]
            less += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, ones + lo - zl, zl), np.where(one, ones + hi - zh, zh)
        return self.before[sym] + lo - self.base[sym], hi - lo, less

    def symbols(self, lo: np.ndarray, size: np.ndarray):
        """(range, symbol, first rank, size, smaller symbols) for every symbol that occurs in each range."""
        own, hi = np.arange(len(lo)), lo + size
        sym, less = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for (bit, zeros), ones in zip(self.zeros, self.ones_at):
            zl, zh = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            lo = np.concatenate((zl, ones + lo - zl))
            hi = np.concatenate((zh, ones + hi - zh))
            less = np.concatenate((less, less + zh - zl))
            sym, own = np.concatenate((sym, sym | 1 << bit)), np.concatenate((own, own))
            live = hi > lo
            lo, hi, less, sym, own = lo[live], hi[live], less[live], sym[live], own[live]
        return own, sym, self.before[sym] + lo - self.base[sym], hi - lo, less


class BidirectionalIndex:
    """FM-index of ``|w1|w2|...|`` and of its reverse, for distinct words in ascending order.

    A state is (rank in the text's order, rank in the reverse's order, size).
    Words are bytes, one a letter; symbol 0 is the delimiter.
    """

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        used = np.unique(raw)
        self.code = np.full(256, -1, np.int64)
        self.code[used] = np.arange(len(used))
        text = self.code[raw]
        bits = max(1, int(len(used) - 1).bit_length())
        depth = max(map(len, words), default=0) + 3
        self.n_words = len(words)
        self.waves = []
        for t in (text, text[::-1]):
            order = suffix_order(t, depth)
            self.waves.append(WaveletMatrix(t[order - 1], bits))

    def start(self, n: int):
        """The state of the delimiter alone, n times."""
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n_words + 1, np.int64)

    def extend(self, right: bool, lo, rlo, size, sym):
        if right:
            rlo, size, less = self.waves[1].step(rlo, size, sym)
            return lo + less, rlo, size
        lo, size, less = self.waves[0].step(lo, size, sym)
        return lo, rlo + less, size

    def branches(self, right: bool, lo, rlo, size):
        """(state, symbol, lo, rlo, size) for each symbol by which a state can grow."""
        if right:
            own, sym, first, n, less = self.waves[1].symbols(rlo, size)
            return own, sym, lo[own] + less, first, n
        own, sym, first, n, less = self.waves[0].symbols(lo, size)
        return own, sym, first, rlo[own] + less, n


def near_words(index: BidirectionalIndex, symbols: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray,
               prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(search, word) pairs: index words of ``length`` one error away from each searched word.

    ``symbols[at:at + size]`` are the searched words (index codes, -1 for
    letters the index does not have).  The error lies between the first
    ``prefix`` and the last ``suffix`` letters of the index word.
    """
    out = []
    for right in (True, False):
        for kind in (0, 1, -1):
            q = np.flatnonzero((length - size == kind) & ((prefix >= suffix) == right))
            for k in range(0, len(q), SEARCHES):
                out += _scheme(index, right, kind, q[k:k + SEARCHES], symbols, at, size, prefix, suffix)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _scheme(index, right, kind, q, symbols, at, size, prefix, suffix):
    """Searches of one direction and one kind of error: 0 replaced, 1 index word longer, -1 index word shorter."""
    head, tail = (prefix, suffix) if right else (suffix, prefix)
    # First and last place, counted from the side the search starts at, where the error may be.
    first, last = head[q], size[q] - tail[q] - (kind < 1)
    if kind == -1:
        if right:
            last = last - (suffix[q] > 0)
        else:
            first = first + (suffix[q] > 0)

    def letter(s, j):
        """Letter j of search s from its side; -2 beyond its ends."""
        n = size[s]
        ok = (j >= 0) & (j < n)
        place = at[s] + np.where(right, j, n - 1 - j)
        return np.where(ok, symbols[np.where(ok, place, 0)], -2)

    found = []
    zero = [np.arange(len(q)), *index.start(len(q))]         # numbers in q, states without an error yet
    one = [np.zeros(0, np.int64)] * 5                        # number in q, place, state after the error
    j = 0
    while len(zero[0]) or len(one[0]):
        fresh = []
        if len(zero[0]):
            stay = last[zero[0]] >= j
            zero = [x[stay] for x in zero]
            on = np.flatnonzero(first[zero[0]] <= j)
            if len(on):
                s = zero[0][on]
                here, side = letter(q[s], j), letter(q[s], j - 1 if right else j)
                if kind == -1:
                    # The leftmost of equal letters is the one left out.
                    use = here != letter(q[s], j - 1 if right else j + 1)
                    on = on[use]
                    fresh = [zero[0][on], np.full(len(on), j + 1), *(x[on] for x in zero[1:])]
                else:
                    own, sym, lo, rlo, n = index.branches(right, *(x[on] for x in zero[1:]))
                    use = (sym != 0) & (sym != (here if kind == 0 else side)[own])
                    own = own[use]
                    fresh = [s[own], np.full(len(own), j + (kind == 0)), lo[use], rlo[use], n[use]]
            zero = _grow(index, right, zero, letter(q[zero[0]], j))
        if len(one[0]):
            sym = letter(q[one[0]], one[1])
            done = one[1] == size[q[one[0]]]
            sym[done] = 0
            grown = _grow(index, right, [np.arange(len(sym)), *one[2:]], sym)
            k = grown[0]
            end = done[k]
            # Rank 0 is the delimiter before the first word, once round the text.
            found.append((q[one[0][k[end]]], grown[1][end] - 1))
            one = [one[0][k[~end]], one[1][k[~end]] + 1, *(x[~end] for x in grown[1:])]
        if fresh:
            one = [np.concatenate(x) for x in zip(one, fresh)]
        j += 1
    return found


def _grow(index, right, state, sym):
    """The states that can grow by their letter, grown; the first entry numbers them."""
    ok = np.flatnonzero(sym >= 0)
    lo, rlo, size = index.extend(right, *(x[ok] for x in state[1:]), sym[ok])
    live = size > 0
    return [state[0][ok[live]], lo[live], rlo[live], size[live]]


def _block(key, table):
    """Of one block: for each asking word how many near words it found, and the best of them."""
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    count_of = {words[k].encode("latin-1"): int(counts[k]) for k in np.flatnonzero(~asks)}
    known = sorted(count_of)
    empty = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "n_near": pa.array([], pa.int64()),
                      "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    if not known or not asks.any():
        return empty
    index = BidirectionalIndex(known)
    ask = np.flatnonzero(asks)
    asked = [words[k].encode("latin-1") for k in ask]
    size = np.array([len(w) for w in asked], np.int64)
    col = [table.column(c).to_numpy()[ask].astype(np.int64) for c in ("length", "prefix", "suffix")]
    s, v = near_words(index, index.code[np.frombuffer(b"".join(asked), np.uint8)], np.cumsum(size) - size, size, *col)
    if not len(s):
        return empty
    n = np.array([count_of[w] for w in known], np.int64)
    # Several searches of one word meet here: number them by word.
    _, at, number = np.unique(np.array(ask, np.int64), return_index=True, return_inverse=True)
    order = np.lexsort((v, -n[v], number[s]))
    s, v = s[order], v[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    near = np.diff(np.append(head, len(s)))
    return pa.table({"word": pa.array([asked[k].decode("latin-1") for k in s[head].tolist()], pa.string()),
                     "n": pa.array(np.zeros(len(head), np.int64)), "n_near": pa.array(near.astype(np.int64)),
                     "best_n": pa.array(n[v[head]]), "best": pa.array([known[k].decode("latin-1") for k in v[head].tolist()], pa.string())})


# --- keys, forms, roots ----------------------------------------------------------------

_KEY = "xxhash64(length, prefix, suffix, left(word, prefix), right(word, suffix))"


def _halved(rows: DataFrame) -> DataFrame:
    """Each row under its two keys with half of the unknown middle made known."""
    middle = "(length - prefix - suffix)"
    parts = F.expr(f"array(struct(prefix + {middle} div 2 as p, suffix as s), struct(prefix as p, suffix + {middle} - {middle} div 2 as s))")
    return rows.withColumn("part", F.explode(parts)).withColumn("prefix", F.col("part.p").cast("int")) \
        .withColumn("suffix", F.col("part.s").cast("int")).drop("part").withColumn("key", F.expr(_KEY))


def keyed(words: DataFrame, hot_words: int = HOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """(index rows, asking rows) of ``words`` with their keys; no key has over ``hot_words`` index rows.

    Words that differ from each other in one known place only cannot be split
    further, and are no more than the alphabet has letters.
    """
    size = F.char_length("word").cast("int")
    none = F.lit(0)
    index = _halved(words.select("word", "n", size.alias("length"), none.alias("prefix"), none.alias("suffix")))
    asks = words.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("length"), none.alias("prefix"), none.alias("suffix"))
    asks = _halved(asks.where(F.col("length") >= MIN_LETTERS))
    done = []
    while True:
        hot = index.where("length - prefix - suffix > 1").groupBy("key").agg(F.count(F.lit(1)).alias("k")) \
            .where(F.col("k") > hot_words).select("key")
        hot = C.materialize(hot, "op13-hot")
        if hot.isEmpty():
            break
        done.append((index.join(hot, "key", "left_anti"), asks.join(hot, "key", "left_anti")))
        index, asks = (C.materialize(_halved(x.join(hot, "key", "left_semi").drop("key")), "op13-split") for x in (index, asks))
    for i, a in done:
        index, asks = index.unionByName(i), asks.unionByName(a)
    return index, asks


def spelling_groups(words: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words with their counts."""
    spark = words.sparkSession
    C.prepare(spark)
    words = C.materialize(words.select("word", F.col("n").cast("long").alias("n")), "op13-words")
    index, asks = keyed(words, hot_words)
    total = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // BLOCK_SYMBOLS + 1)
    rows = index.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True))) \
        .withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).drop("key")
    found = rows.repartition(blocks, "block").groupBy("block") \
        .applyInArrow(_block, "word string, n long, n_near long, best_n long, best string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                       F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best")))
    near = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    takes = -F.col("b.minus") >= RATIO * F.col("n")
    near = C.materialize(near.select("word", "n", "n_near", F.when(takes, F.col("b.best")).alias("form"),
                                     F.when(takes, -F.col("b.minus")).alias("form_n")), "op13-near")
    roots = root_words(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def root_words(forms: DataFrame) -> DataFrame:
    """word, root: where the forms lead; every round doubles the steps taken."""
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        nxt = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = C.materialize(step.join(nxt, "root", "left")
                             .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "op13-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(corpus_words(C.load(spark, sf_dir, "documents")))
