"""Best-fit packing by a grouping genetic algorithm on islands.

A document's token ids and an end id are cut into pieces of at most CAPACITY
tokens; the pieces are packed into as few sequences as possible.

* Pieces are dealt by hash into blocks of about BLOCK pieces.  Every block has
  ISLANDS populations of packings (a packing is a list of bins), each row of
  the frame one island, so blocks and islands evolve on different executors.
* Crossover injects whole well-filled bins of one parent into the other,
  removes the bins that would repeat a piece, and best-fits the displaced
  pieces.  Mutation dissolves the emptiest bins.  Fitness is Falkenauer's mean
  of squared fill.
* After each epoch the elites move to the next island of the ring (a join on
  block and island).
* Bins that are nearly full are final.  The pieces of the others meet in fewer,
  new blocks at the next level, until one block is left: the rounding loss of
  a block is not paid for every block.

Full pieces are sequences of their own.  Every random choice is seeded by level,
block, island and epoch; the deal also takes the row's number in the table, so
that equal rows do not meet in one block.

Defined cases: a null or empty text is its end id alone (one piece of length
1).  Repeated rows are packed as often as they occur.  A null doc_id is kept.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import random
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
BLOCK = 1500
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 4
POPULATION = 6
ELITES = 2
MAX_LEVELS = 5
#: A bin with at most this many free tokens is final before the last level.
KEEP_FREE = 2
CACHE_WORDS = 100_000
CACHE_CHARS = 48
#: Words whose ids a worker remembers as arrays (about 30 bytes a word), and bytes of text encoded at once.
KNOWN_WORDS = 400_000
TEXT_BYTES = 4 << 20


# --- pieces ---------------------------------------------------------------

_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_PLAIN_LETTERS = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _parts(word: str) -> tuple[str, str, str] | None:
    """ASCII punctuation before and after a word, which are pre-tokens of their own next to a letter or digit;
    None where that is not certain: with a special token, or a letter that the normalizer ends in a mark."""
    core = word.strip(_PUNCTUATION)
    if not core or len(core) == len(word) or "<|" in word:
        return None
    head, _, tail = word.partition(core)
    first, last = core[0], unicodedata.normalize("NFC", core[-1]).lower()[-1]
    if head and not first.isalnum() or tail and not last.isalnum():
        return None
    return head, core, tail


class _Ids(dict):
    """Little-endian ids of words between blanks; the pre-tokenizer never joins two of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not t.normalized]
        self.mark, self.mark_id = special[0] if special else (None, -1)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocab.values()) + 1, bool) if self.tokenizer.model.end_of_word_suffix else None
        if self.final is not None:
            for piece, i in vocab.items():
                self.final[i] = piece.endswith(self.tokenizer.model.end_of_word_suffix)
        self[""] = b""
        # Encoding plain words can do without a normalizer that leaves all pairs of their letters as they are.
        pairs = " ".join(a + b for a in _PLAIN_LETTERS for b in _PLAIN_LETTERS)
        self.normalizer = self.tokenizer.normalizer
        self.bare = self.normalizer is not None and self.normalizer.normalize_str(pairs) == pairs
        self.old: dict[str, bytes] = {}                 # the table before the last change: what is asked for again moves over
        self.long: list[str] = []

    def learn(self, words: set[str]) -> None:
        """Encode the missing words of some texts together.  A full table becomes the old one."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        new = self._missing(words)
        split = {w: parts for w in new if (parts := _parts(w))}
        new = new.difference(split).union(self._missing({x for parts in split.values() for x in parts}))
        plain = [w for w in new if _PLAIN(w)]
        if not self._learn_plain(plain):
            plain = []
        self._learn_marked([w for w in new.difference(plain)])
        for w, (head, core, tail) in split.items():
            self[w] = self[head] + self[core] + self[tail]
        self.long += [w for w in new.union(split) if len(w) > CACHE_CHARS]

    def _missing(self, words: set[str]) -> set[str]:
        """Of ``words`` those that neither table has."""
        missing = {w for w in words if w not in self}
        old = self.old
        for w in [w for w in missing if w in old] if old else ():
            self[w] = old[w]
            missing.discard(w)
        return missing

    def _encode(self, strings: list[str]):
        for k in range(0, len(strings), 64):
            part = self.tokenizer.encode_batch_fast(strings[k:k + 64], add_special_tokens=False)
            yield np.concatenate([np.asarray(e.ids, "<u4") for e in part])

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that are one pre-token each, and how many each has: the last piece of a pre-token is marked as
        such.  None where that does not tell them apart."""
        if self.final is None:
            return None
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.bare:
            from tokenizers import normalizers
            self.tokenizer.normalizer = normalizers.Sequence([])
        try:
            ids = np.concatenate(list(self._encode([" ".join(words[i:i + 256]) for i in range(0, len(words), 256)])))
        finally:
            if self.bare:
                self.tokenizer.normalizer = self.normalizer
        ends = np.flatnonzero(self.final[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else None

    def _learn_plain(self, words: list[str]) -> bool:
        found = self.plain(words)
        if found is None:
            return not words
        data, start = found[0].tobytes(), 0
        for w, n in zip(words, (found[1] * 4).tolist()):
            self[w] = data[start:start + n]
            start += n
        return True

    def _learn_marked(self, new: list[str]) -> None:
        """Any words: a special token between them is cut out before anything else."""
        alone = [w for w in new if self.mark is None or "<|" in w]
        for w in alone:
            self[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        new = [w for w in new if self.mark is not None and "<|" not in w]
        at = 0
        for ids in self._encode([self.mark.join(new[k:k + 256]) + self.mark for k in range(0, len(new), 256)]):
            data, ends, start = ids.tobytes(), (np.flatnonzero(ids == self.mark_id) * 4).tolist(), 0
            for w, end in zip(new[at:at + len(ends)], ends):
                self[w] = data[start:end]
                start = end + 4
            at += len(ends)

    def drop_long(self) -> None:
        """Forget the long words of the last texts."""
        for w in self.long:
            self.pop(w, None)
        self.long.clear()


def _words(text: str | None) -> list[str]:
    """Parts between blanks and line feeds, A-Z lower-cased as the normalizer will do
    (not where that could spell a special token)."""
    if not text:
        return [""]
    if "<|" not in text:
        text = text.encode().lower().decode()
    return text.replace("\n", " ").split(" ")


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x0A]] = True
_CUTTING = np.zeros(256, bool)
_CUTTING[list(_PUNCTUATION.encode())] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Second bytes (after 0xC3) of the letters U+00C0 to U+00FF, and all bytes of plain words.
_SECOND = np.zeros(256, bool)
_SECOND[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_PLAIN_BYTE = np.zeros(256, bool)
_PLAIN_BYTE[[0xC3, *range(97, 123), *(c for c in range(0x9F, 0xC0) if c != 0xB7)]] = True


def cut_words(raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of the rows in ``raw`` and the number of each row's first one (n_rows + 1 entries).

    Words lie between blanks and line feeds, and end where ASCII punctuation
    other than an apostrophe meets a digit or a letter up to U+00FF: the
    pre-tokenizer never joins these.  A-Z is lower-cased as the normalizer will
    do.  Rows marked in ``whole`` (they may spell a special token) are neither
    lower-cased nor cut at punctuation.
    """
    rows = len(offsets) - 1
    n = len(raw)
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(rows + 1, np.int64)
    keep = ~_SEPARATOR[raw]
    start = keep.copy()
    second = np.zeros(n, bool)
    second[1:] = (raw[:-1] == 0xC3) & _SECOND[raw[1:]]
    ascii_alnum, cutting = _ALNUM[raw], _CUTTING[raw]
    ends, begins = ascii_alnum | second, ascii_alnum.copy()
    begins[:-1] |= second[1:]
    cut = np.zeros(n, bool)
    cut[1:] = (ends[:-1] & cutting[1:]) | (cutting[:-1] & begins[1:])
    low = C._LOWER[raw]
    if whole.any():
        same = np.repeat(whole, np.diff(offsets))
        cut[same] = False
        low[same] = raw[same]
    start[1:] &= ~keep[:-1] | cut[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = keep[first]
    data = low[keep]
    at = np.append(np.flatnonzero(start[keep]), len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    kind = pa.binary() if at.dtype == np.int32 else pa.large_binary()
    words = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
    return words, np.searchsorted(np.flatnonzero(start), offsets)


class _Encoder:
    """Ids of whole texts: each different word of some texts is encoded once, and a bounded table of words is kept
    as arrays (words, their ids one after the other, and where each word's ids start)."""

    def __init__(self, path: str):
        self.ids = _Ids(path)
        self._keep(pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def _keep(self, words: pa.Array, flat: np.ndarray, at: np.ndarray) -> None:
        self.words, self.flat, self.at = words, flat, at

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` one after the other, and how many each has."""
        raw, off = C.string_buffers(words.cast(pa.string()))
        odd = np.concatenate(([0], np.cumsum(~_PLAIN_BYTE[raw])))
        plain = odd[off[1:]] == odd[off[:-1]]
        texts = np.array(words.cast(pa.string()).to_pylist(), object)
        found = self.ids.plain(texts[plain].tolist())
        if found is None:
            plain[:] = False
            found = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        others = texts[~plain].tolist()
        self.ids.learn(set(others))
        data = list(map(self.ids.__getitem__, others))
        self.ids.drop_long()
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[~plain] = found[1], [len(d) // 4 for d in data]
        flat = np.empty(int(counts.sum()), "<u4")
        of_plain = np.repeat(plain, counts)
        flat[of_plain], flat[~of_plain] = found[0], np.frombuffer(b"".join(data), "<u4")
        return flat, counts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``end_id`` after each, and where each text's ids start (n + 1 entries)."""
        raw, off = C.string_buffers(texts)
        whole = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
        words, first = cut_words(raw, off, whole)
        coded = words.dictionary_encode()
        different = coded.dictionary
        known = pc.index_in(different, value_set=self.words)
        missing = known.is_null().to_numpy(zero_copy_only=False)
        fresh = different.filter(pa.array(missing))
        flat, counts = self._new(fresh)
        starts = np.empty(len(different) + 1, np.int64)
        sizes = np.ones(len(different) + 1, np.int64)
        old = known.drop_null().to_numpy()
        starts[:-1][~missing], sizes[:-1][~missing] = self.at[old], self.at[old + 1] - self.at[old]
        starts[:-1][missing], sizes[:-1][missing] = len(self.flat) + np.cumsum(counts) - counts, counts
        pool = np.concatenate((self.flat, flat, np.asarray([end_id], "<u4")))
        starts[-1] = len(pool) - 1
        ends = first[1:] + np.arange(len(texts))
        word = np.empty(len(words) + len(texts), np.int32)
        is_word = np.ones(len(word), bool)
        is_word[ends] = False
        word[is_word], word[ends] = coded.indices.to_numpy(), len(different)
        ids, at = _gather(pool, starts, sizes, word)
        self._remember(different, fresh, pool, starts, sizes, missing)
        return ids, np.append(0, at[ends + 1])

    def _remember(self, different: pa.Array, fresh: pa.Array, pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, missing: np.ndarray) -> None:
        """Add the new words that are not long; a full table is begun anew with the words of the last texts."""
        full = len(self.words) + len(fresh) > KNOWN_WORDS
        use = np.flatnonzero((pc.binary_length(different).to_numpy() <= CACHE_CHARS) & (missing | full))[:KNOWN_WORDS]
        words, (flat, at) = different.take(pa.array(use)), _gather(pool, starts, sizes, use)
        if not full:
            words = pa.concat_arrays([self.words, words])
            flat, at = np.concatenate((self.flat, flat)), np.concatenate((self.at, self.at[-1] + at[1:]))
        self._keep(words, flat, at)


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``pool`` one after the other, and where each starts (one more entry: the end)."""
    n = sizes[which]
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    kind = np.int32 if max(int(at[-1]), len(pool)) < 1 << 31 else np.int64
    return pool[np.repeat((starts[which] - at[:-1]).astype(kind), n) + np.arange(at[-1], dtype=kind)], at


_tables: dict[str, _Encoder] = {}


def _table(name: str) -> _Encoder:
    if name not in _tables:
        import public_tokenizers
        _tables[name] = _Encoder(name if os.sep in name else public_tokenizers.path(name))
    return _tables[name]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; with_ids adds the
    ids themselves as little-endian unsigned 32-bit binary."""
    C.prepare(docs.sparkSession)

    def run(batches):
        table = _table(tokenizer)
        for b in batches:
            texts = b.column("text")
            for i, j in C.row_slices(C.string_buffers(texts)[1], TEXT_BYTES):
                ids, at = table.encode(texts.slice(i, j - i), end_id)
                out = [[], [], [], [], [], []]
                for doc_id, x, y in zip(b.column("doc_id").slice(i, j - i).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    for k in range(x, y, capacity):
                        part = ids[k:min(k + capacity, y)]
                        for col, v in zip(out, (doc_id, (k - x) // capacity, k - x, len(part), zlib.crc32(part), part.tobytes() if with_ids else None)):
                            col.append(v)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(out[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# --- the algorithm inside one island ----------------------------------------

def best_fit(bins: list[list[int]], free: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Put ``items`` one by one into the bin that they fill best, or a new one."""
    order = sorted((f, k) for k, f in enumerate(free) if f)
    for i in items:
        at = bisect.bisect_left(order, (size[i], -1))
        if at < len(order):
            f, k = order.pop(at)
            bins[k].append(i)
            free[k] = f - size[i]
        else:
            k = len(bins)
            bins.append([i])
            free.append(capacity - size[i])
        if free[k]:
            bisect.insort(order, (free[k], k))


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> float:
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Child of ``a`` with whole well-filled bins of ``b`` injected."""
    fill = sorted(((sum(size[i] for i in x), k) for k, x in enumerate(b)), reverse=True)
    full = fill[:max(1, len(fill) // 2)]
    take = rng.sample(full, max(1, len(full) // 3))
    bins = [list(b[k]) for _, k in take]
    taken = {i for x in bins for i in x}
    displaced = []
    for x in a:
        if taken.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return _refill(bins, displaced, size, capacity)


def mutate(a: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolve the emptiest bins and a few others, and best-fit their pieces."""
    order = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))
    drop = set(order[:2]) | set(rng.sample(order, min(len(order), 1 + len(order) // 20)))
    return _refill([list(x) for k, x in enumerate(a) if k not in drop], [i for k in drop for i in a[k]], size, capacity)


def _refill(bins, displaced, size, capacity):
    free = [capacity - sum(size[i] for i in x) for x in bins]
    displaced.sort(key=lambda i: -size[i])
    best_fit(bins, free, displaced, size, capacity)
    return bins


def first_packing(size: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    """Best fit in decreasing order, the order blurred by ``noise``."""
    order = sorted(range(len(size)), key=lambda i: -size[i] * (1 + noise * rng.random()))
    bins: list[list[int]] = []
    best_fit(bins, [], order, size, capacity)
    return bins


def _pack_genes(bins: list[list[int]], n: int) -> bytes:
    g = array("i", bytes(4 * n))
    for k, b in enumerate(bins):
        for i in b:
            g[i] = k
    return g.tobytes()


def _bins_of(genes: bytes) -> list[list[int]]:
    g = np.frombuffer(genes, "<i4")
    if not len(g):
        return []
    order = np.argsort(g, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(g[order])) + 1)]


def evolve(size: list[int], start: list[bytes], capacity: int, seed: int) -> list[tuple[float, bytes]]:
    """One epoch of an island: the fittest packings of its population, best first."""
    rng = random.Random(seed)
    pop = [_bins_of(g) for g in start]
    while len(pop) < POPULATION:
        pop.append(first_packing(size, capacity, rng, 0.0 if not pop else 0.3))
    bound = -(-sum(size) // capacity)
    scored = sorted(((fitness(x, size, capacity), k) for k, x in enumerate(pop)), reverse=True)
    pop = [pop[k] for _, k in scored][:POPULATION]
    fit = [f for f, _ in scored][:POPULATION]
    for _ in range(GENERATIONS):
        if len(pop[0]) <= bound:
            break                                       # no packing has fewer bins
        a, b = rng.sample(range(max(2, POPULATION // 2)), 2)
        for child in (cross(pop[a], pop[b], size, capacity, rng), cross(pop[b], pop[a], size, capacity, rng),
                      mutate(pop[a], size, capacity, rng)):
            f = fitness(child, size, capacity)
            if f > fit[-1]:
                at = bisect.bisect_left([-x for x in fit], -f)
                pop.insert(at, child)
                fit.insert(at, f)
                pop.pop()
                fit.pop()
    return [(f, _pack_genes(x, len(size))) for f, x in zip(fit, pop)]


# --- blocks, islands and levels on Spark ------------------------------------

def _epoch(capacity: int, level: int, epoch: int):
    def run(frames):
        for pdf in frames:
            genes, fits = [], []
            for r in pdf.itertuples(index=False):
                seed = zlib.crc32(repr((level, int(r.block), int(r.island), epoch)).encode())
                best = evolve([int(x) for x in r.sizes], [bytes(g) for g in r.genes], capacity, seed)
                genes.append([g for _, g in best])
                fits.append(best[0][0])
            yield pd.DataFrame({"block": pdf["block"], "island": pdf["island"], "sizes": pdf["sizes"], "genes": genes, "fit": fits})
    return run


def _spread(capacity: int, level: int, keep_free: int):
    """Bins of the best packing as rows; ``final`` tells those that stay."""
    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, b in enumerate(_bins_of(bytes(r.genes))):
                    fill = sum(int(r.sizes[i]) for i in b)
                    at = 0
                    for i in b:
                        x = r.items[i]
                        rows.append((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"],
                                     (level << 56) + (int(r.block) << 20) + k, at, capacity - fill <= keep_free))
                        at += int(r.sizes[i])
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "final"]) \
                .astype({"doc_id": "Int64", "piece": "int32"})
    return run


def _level(items: DataFrame, n: int, capacity: int, level: int, last: bool) -> DataFrame:
    n_blocks = max(1, round(n / BLOCK))
    # The row's number as well: rows that are equal in all columns are dealt over all blocks.
    items = items.withColumn("deal", F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal", F.lit(level)), F.lit(n_blocks)).alias("block")
    fields = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    blocks = C.materialize(items.groupBy(block).agg(F.array_sort(F.collect_list(fields)).alias("items")), f"op2-blocks{level}")
    sizes = blocks.select("block", F.transform("items", lambda x: x["length"]).alias("sizes"))
    state = sizes.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes",
                         F.array().cast("array<binary>").alias("genes"))
    parts = min(n_blocks * ISLANDS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    state = state.repartition(parts, "block", "island")
    schema = "block long, island int, sizes array<long>, genes array<binary>, fit double"
    for epoch in range(EPOCHS):
        state = C.materialize(state.mapInPandas(_epoch(capacity, level, epoch), schema), f"op2-epoch{level}-{epoch}")
        if epoch + 1 < EPOCHS:
            guests = state.select("block", F.expr(f"(island + 1) % {ISLANDS}").alias("island"),
                                  F.slice("genes", 1, ELITES).alias("guests"))
            state = state.join(guests, ["block", "island"]).select("block", "island", "sizes", F.concat("genes", "guests").alias("genes"))
    best = state.groupBy("block").agg(F.max_by(F.struct(F.col("genes")[0].alias("genes"), "sizes"),
                                               F.struct("fit", F.col("island"))).alias("x"))
    out = blocks.join(best, "block").select("block", "items", "x.sizes", "x.genes")
    return C.materialize(out.mapInPandas(_spread(capacity, level, capacity if last else KEEP_FREE),
                                         "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                         "sequence_id long, offset long, final boolean"), f"op2-level{level}")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for each row of ``items`` (doc_id, piece, start, length, ids_crc32)."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = items.where(F.col("length") >= capacity) \
        .withColumn("sequence_id", F.lit(127 << 56) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done, rest, level = [whole.select(cols)], items.where(F.col("length") < capacity), 0
    n = rest.count()
    while n:
        last = n <= BLOCK or level + 1 >= MAX_LEVELS
        out = _level(rest, n, capacity, level, last)
        done.append(out.where("final").select(cols))
        if last:
            break
        rest = out.where("not final").drop("sequence_id", "offset", "final")
        n, before = rest.count(), n
        level = MAX_LEVELS - 1 if n > 0.9 * before else level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(C.materialize(pieces(docs, tokenizer, capacity), "op2-pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.load(spark, sf_dir, "documents"))
