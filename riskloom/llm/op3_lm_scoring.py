"""LM scoring with a weighted backoff automaton.

A bigram model is learned from all training documents.  Its smoothed n-grams
(Witten-Bell) are the states and arcs of an automaton: a state for each context
seen in training, an explicit arc for each seen bigram, and from each state one
failure arc with the backoff weight to the root, whose arcs are the smoothed
unigrams.  One left-to-right traversal carries the state (the word just read,
or the root) and accumulates log10 probabilities.

The whole model never sits in one place.  Documents are gathered into blocks of
about BLOCK_TOKENS tokens; each block asks for just the n-grams it holds:

1. a block sends its distinct words and bigrams with their training counts to
   buckets by hash (counted in the block first, so a frequent n-gram is one
   entry of a block);
2. a bucket adds up the counts over all blocks and answers each block in the
   order of its request; the first block that holds a trained bigram is told to
   credit its context with one more follower;
3. the followers of each context are added up in the same way;
4. a block builds the part of the automaton that its documents can reach and
   traverses it.

N-grams are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; the score covers
the end token.  A null doc_id counts as training.  Repeated rows count as often
as they occur.  Without any training row all probabilities are uniform over one
unseen token (log10 1 = 0).  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

BLOCK_TOKENS = 1_500_000
BUCKET_ENTRIES = 1_500_000
HELD_OUT_OF, HELD_OUT_AT = 5, 1
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def _z(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _un(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)


def _z64(a: np.ndarray) -> bytes:
    """Hashes do not shrink: kept as they are."""
    return np.ascontiguousarray(a).tobytes()


# --- blocks -------------------------------------------------------------------

_BLOCK_FIELDS = [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                 ("n", pa.list_(pa.int64())), ("vocab", pa.binary()), ("ids", pa.binary())]
_BLOCK_DDL = "block long, doc_id array<long>, held_out array<boolean>, n array<long>, vocab binary, ids binary"


def _blocks(batches):
    """Rows of whole documents: their token counts, distinct token hashes and token numbers."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def flush():
        nonlocal made
        tokens = np.concatenate([h[0] for h in held])
        vocab, ids = np.unique(tokens, return_inverse=True)
        cols = [[(task << 32) + made], [[x for h in held for x in h[2]]],
                [[x for h in held for x in h[3]]], [np.concatenate([h[1] for h in held]).tolist()],
                [_z64(vocab)], [_z(ids.astype(np.uint32))]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _BLOCK_FIELDS)],
                                          schema=pa.schema(_BLOCK_FIELDS))

    for b in batches:
        raw, off = C.string_buffers(b.column("text"))
        ids, out = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
        for i, j in C.row_slices(off):
            h, _, _, first = C.words_of(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            n = np.diff(first)
            tokens = np.full(len(h) + j - i, _END, np.uint64)
            tokens[np.arange(len(h)) + np.repeat(np.arange(j - i), n)] = h
            held.append((tokens, n + 1, ids[i:j], out[i:j]))
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class _Block:
    """A block's tokens with their contexts; bigrams numbered by (context, word)."""

    def __init__(self, vocab: bytes, ids: bytes, n: np.ndarray, held: np.ndarray):
        self.vocab = np.frombuffer(vocab, np.uint64)
        self.start = len(self.vocab)                       # local number of the start context
        self.ids = _un(ids, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.trained = ~held[self.doc]
        context = np.empty_like(self.ids)
        context[1:] = self.ids[:-1]
        context[np.cumsum(n) - n] = self.start
        self.pairs, self.pair_of = np.unique(context * (self.start + 1) + self.ids, return_inverse=True)
        self.context, self.word = self.pairs // (self.start + 1), self.pairs % (self.start + 1)

    def hashes(self) -> np.ndarray:
        return np.append(self.vocab, _START)

    def keys(self) -> np.ndarray:
        h = self.hashes()
        return C.mix64(h[self.context] * np.uint64(0xD1342543DE82EF95) + h[self.word])


def _of_row(row: dict) -> _Block:
    return _Block(row["vocab"], row["ids"], np.array(row["n"], np.int64), np.array([bool(x) for x in row["held_out"]]))


def _by_bucket(key: np.ndarray, n_buckets: int) -> list[np.ndarray]:
    """Index arrays of each bucket, in ascending order inside a bucket."""
    bucket = (key % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n_buckets)))


# --- requests and answers --------------------------------------------------------

def _requests(n_buckets: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                x = _of_row(row)
                uni = np.bincount(x.ids[x.trained], minlength=x.start).astype(np.uint32)
                bi = np.bincount(x.pair_of[x.trained], minlength=len(x.pairs)).astype(np.uint32)
                keys = x.keys()
                for k, (u, p) in enumerate(zip(_by_bucket(x.vocab, n_buckets), _by_bucket(keys, n_buckets))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([row["block"]], pa.int64())] +
                        [pa.array([v], pa.binary()) for v in (_z64(x.vocab[u]), _z(uni[u]), _z64(keys[p]), _z(bi[p]),
                                                              _z(x.context[p].astype(np.uint32)))],
                        names=["bucket", "block", "words", "word_n", "pairs", "pair_n", "contexts"])
    return run


_REQUEST_DDL = "bucket int, block long, words binary, word_n binary, pairs binary, pair_n binary, contexts binary"


def _totals(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total count of every entry, and where each key with a count first has one."""
    key, n = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
    _, inverse = np.unique(key, return_inverse=True)
    total = np.zeros(inverse.max(initial=-1) + 1, np.int64)
    np.add.at(total, inverse, n)
    have = np.flatnonzero(n)
    _, at = np.unique(inverse[have], return_index=True)
    owner = np.zeros(len(key), bool)
    owner[have[at]] = True
    return total[inverse], owner, total


def _answer(key, table):
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    pairs = [np.frombuffer(r["pairs"], np.uint64) for r in rows]
    word_total, _, each = _totals(words, [_un(r["word_n"], np.uint32) for r in rows])
    pair_total, owner, _ = _totals(pairs, [_un(r["pair_n"], np.uint32) for r in rows])
    out = {k: [] for k in ("block", "bucket", "known", "word_n", "pair_n", "followers")}
    u = p = 0
    for i, r in enumerate(rows):
        lu, lp = len(words[i]), len(pairs[i])
        ctx = _un(r["contexts"], np.uint32)[owner[p:p + lp]]
        for k, v in (("block", r["block"]), ("bucket", key[0].as_py()), ("known", int((each > 0).sum()) if i == 0 else 0),
                     ("word_n", _z(word_total[u:u + lu].astype(np.uint64))), ("pair_n", _z(pair_total[p:p + lp].astype(np.uint64))),
                     ("followers", _z(ctx))):
            out[k].append(v)
        u, p = u + lu, p + lp
    return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["known"], pa.int64()),
                     *[pa.array(out[k], pa.binary()) for k in ("word_n", "pair_n", "followers")]], names=list(out))


_ANSWER_DDL = "block long, bucket int, known long, word_n binary, pair_n binary, followers binary"


def _follower_requests(n_buckets: int):
    def run(key, left, right):
        h = np.append(np.frombuffer(left.column("vocab")[0].as_py(), np.uint64), _START)
        n = np.zeros(len(h), np.int64)
        for x in right.column("followers"):
            n += np.bincount(_un(x.as_py(), np.uint32).astype(np.int64), minlength=len(h))
        parts = _by_bucket(h, n_buckets)
        return pa.table([pa.array(range(n_buckets), pa.int32()), pa.array([key[0].as_py()] * n_buckets, pa.int64()),
                         pa.array([_z64(h[x]) for x in parts], pa.binary()),
                         pa.array([_z(n[x].astype(np.uint32)) for x in parts], pa.binary())],
                        names=["bucket", "block", "words", "n"])
    return run


def _follower_answer(key, table):
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    total, _, _ = _totals(words, [_un(r["n"], np.uint32) for r in rows])
    cut = np.cumsum([0] + [len(w) for w in words])
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()),
                     pa.array([_z(total[i:j].astype(np.uint64)) for i, j in zip(cut, cut[1:])], pa.binary())],
                    names=["block", "bucket", "followers"])


# --- the automaton -----------------------------------------------------------------

class BackoffAutomaton:
    """States are contexts (local word numbers, the last one is the start); the root has no context.

    ``arc``: log10 weight of the way from a bigram's state over its word: the
    explicit arc where the bigram was seen, else the failure arc to the root
    and the root's arc.  A context that was never seen is the root itself.
    """

    def __init__(self, context, word, pair_n, word_n, followers, train_tokens: int, known: int, train_docs: int):
        self.root = np.log10((word_n + 0.5) / (train_tokens + 0.5 * (known + 1)))
        seen = np.append(word_n, train_docs)[context].astype(np.float64)
        kinds = followers[context].astype(np.float64)
        p = 10.0 ** self.root[word]
        with np.errstate(divide="ignore", invalid="ignore"):
            explicit = np.log10((pair_n + kinds * p) / (seen + kinds))
            failure = np.log10(kinds / (seen + kinds)) + self.root[word]
        self.arc = np.where(seen + kinds == 0, self.root[word], np.where(pair_n > 0, explicit, failure))

    def traverse(self, pair_of: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Accumulated weight of each document; pair_of[i] is the state before token i with the token itself."""
        return np.bincount(doc, self.arc[pair_of], n_docs)


def _score(n_buckets: int, train_tokens: int, known: int, train_docs: int):
    def run(key, left, right):
        row = left.to_pylist()[0]
        x = _of_row(row)
        h = x.hashes()
        word_n, followers, pair_n = np.zeros(x.start, np.int64), np.zeros(len(h), np.int64), np.zeros(len(x.pairs), np.int64)
        by_word, by_pair, by_context = (_by_bucket(k, n_buckets) for k in (x.vocab, x.keys(), h))
        for r in right.to_pylist():
            k = r["bucket"]
            if r["word_n"] is not None:
                word_n[by_word[k]] = _un(r["word_n"], np.uint64)
                pair_n[by_pair[k]] = _un(r["pair_n"], np.uint64)
            else:
                followers[by_context[k]] = _un(r["followers"], np.uint64)
        automaton = BackoffAutomaton(x.context, x.word, pair_n, word_n, followers, train_tokens, known, train_docs)
        n_docs = len(row["n"])
        return pa.table([
            pa.array(row["doc_id"], pa.int64()), pa.array([bool(v) for v in row["held_out"]], pa.bool_()),
            pa.array(row["n"], pa.int64()), pa.array(np.bincount(x.doc, word_n[x.ids] > 0, n_docs).astype(np.int64)),
            pa.array(np.full(n_docs, train_tokens, np.int64)), pa.array(np.bincount(x.doc, automaton.root[x.ids], n_docs)),
            pa.array(automaton.traverse(x.pair_of, x.doc, n_docs))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT_AT, F.lit(False))


def lm_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    C.prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    blocks = C.materialize(src.mapInArrow(_blocks, _BLOCK_DDL), "op3-blocks")
    per_doc = blocks.select(F.explode(F.arrays_zip("held_out", "n")).alias("d"))
    sums = per_doc.agg(F.sum("d.n").alias("all"), F.sum(F.when(~F.col("d.held_out"), F.col("d.n"))).alias("train"),
                       F.sum(F.when(~F.col("d.held_out"), 1)).alias("docs")).first()
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sums["all"] or 0) // BUCKET_ENTRIES + 1)

    asked = blocks.mapInArrow(_requests(n_buckets), _REQUEST_DDL)
    answers = C.materialize(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER_DDL), "op3-answers")
    known = answers.agg(F.sum("known")).first()[0] or 0
    followers = blocks.select("block", "vocab").groupBy("block") \
        .cogroup(answers.select("block", "followers").groupBy("block")) \
        .applyInArrow(_follower_requests(n_buckets), "bucket int, block long, words binary, n binary") \
        .groupBy("bucket").applyInArrow(_follower_answer, "block long, bucket int, followers binary")
    replies = answers.select("block", "bucket", "word_n", "pair_n", F.lit(None).cast("binary").alias("followers")) \
        .unionByName(followers.select("block", "bucket", F.lit(None).cast("binary").alias("word_n"),
                                      F.lit(None).cast("binary").alias("pair_n"), "followers"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _score(n_buckets, sums["train"] or 0, known, sums["docs"] or 0),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(C.load(spark, sf_dir, "documents"))
