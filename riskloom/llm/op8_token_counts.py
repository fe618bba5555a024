"""Token counts by heap-and-linked-list byte-pair merging.

Counts the tokens that a piece vocabulary with byte fallback gives a text,
without emitting any id: the text's characters are the initial symbols, a heap
holds the adjacent pairs that form a piece, the pair of lowest rank (leftmost
among equals) is merged in a doubly linked list until none is left, and the
count is the number of initial symbols minus the merges (a symbol that is no
piece counts as its UTF-8 bytes).

No piece holds a space mark after another character, nor a line break, so
merges never cross from one word to the next: words are counted on their own
and a bounded table remembers the counts of short ones.  Both facts are checked
against the vocabulary when it is loaded.

The vocabulary must use the identity normaliser with a leading space mark.
Special strings in a text are ordinary text.  Null and empty texts have 0
tokens; texts of any length are counted whole; repeated rows and other columns
have no influence; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Words remembered by a worker, and the longest word that is.
CACHE_WORDS = 400_000
CACHE_CHARS = 48
_MARK = "▁"


def count_symbols(text: str, rank: dict[str, int]) -> int:
    """Symbols left after all merges of ``text``; ``rank`` maps pieces, lowest first."""
    n = len(text)
    if n == 1:
        return 1 if text in rank else len(text.encode())
    end = list(range(1, n + 1))      # symbol i is text[i:end[i]]; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    get = rank.get
    for i in range(n - 1):
        r = get(text[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= stop or end[mid] != stop:
            continue                 # one of its symbols has changed since
        end[i], end[mid] = stop, 0
        merges += 1
        if stop < n:
            before[stop] = i
            r = get(text[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        j = before[i]
        if j >= 0:
            r = get(text[j:stop])
            if r is not None:
                heapq.heappush(heap, (r, j, stop))
    count, i = n - merges, 0
    while i < n:
        if end[i] == i + 1 and text[i] not in rank:
            count += len(text[i].encode()) - 1
        i = end[i]
    return count


class _Counts(dict):
    """Counts of words; a missing one is merged, and kept when it is short."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank

    def __missing__(self, word: str) -> int:
        n = count_symbols(word, self.rank)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    def __init__(self, model_path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        rank = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        if any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in rank):
            raise ValueError("pieces across words: the text cannot be cut into words")
        self.counts = _Counts(rank)
        self.cut = re.compile(f"\n|{_MARK}*[^{_MARK}\n]+|{_MARK}+").findall

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.cut(_MARK + text.replace(" ", _MARK))))


_counters: dict[str, TokenCounter] = {}


def counter(name: str) -> TokenCounter:
    """The worker's counter for a vocabulary file: a path or a name of the installed set."""
    if name not in _counters:
        import os

        import public_tokenizers
        _counters[name] = TokenCounter(name if os.sep in name else public_tokenizers.path(name))
    return _counters[name]


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT,
                 text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    C.prepare(docs.sparkSession)

    def run(batches):
        count = counter(model)
        for b in batches:
            tokens = [count(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64()),
                                              pa.array([n > limit for n in tokens], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")) \
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.load(spark, sf_dir, "documents"))
