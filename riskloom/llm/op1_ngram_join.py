"""N-gram Jaccard join by set-relation skipping (exact).

A text's set holds its distinct 5-word shingles (64-bit hashes).  Two texts
link when |A n B| / |A u B| >= 0.8.  The join finds all links between different
sets without emitting the pairs inside a group of copies:

1. ``sketch``  one pass counts shingles into a fixed table of 2^22 counters
   (count sketch, 4 MB as log2 levels); (level, hash) is one total order for
   all sets, rare shingles first.  Any order gives exact results; this one
   keeps passages that many documents share out of the prefixes.
2. ``index``   each different set posts its prefix (n - ceil(0.8 n) + 1 first
   shingles).  Posting lists are split over buckets by shingle; shingles with a
   very large count are spread instead.  Only lists of two sets or more stay.
3. index skipping: the entries of a list carry size and position; blocks of a
   list whose size or position bound rules out the needed overlap are skipped
   before their members are expanded, and a pair must share as many prefix
   shingles as its sizes demand.
4. answer skipping: in each list the entry with the smallest position is the
   pivot; a set is verified against the pivot with which it shares most prefix
   shingles, and derives its answers from the pivot's: inside one component
   nothing is compared again, and a pair (x, y) is dropped when the verified
   distances to a common pivot p give d(x,y) >= |d(x,p) - d(y,p)| > 0.2
   (Jaccard distance is a metric).
5. what is left between different components shares a list.  A pair must share
   as many shingles of its prefixes as its sizes demand; those in lists of up to
   HOT_LIST sets are counted, and in the rest, the long lists, two sets share no
   more than the one in fewer of them holds.  Pairs that share long lists only
   fall in two kinds.  Where one set is in few long lists (a line that many texts
   hold), it can only link with sets of quite another size, so hardly any pair
   of such a list is written out.  The others are in many long lists (a group of
   near copies) and are joined through differences: each is verified against the
   set that most of the long lists hold, and keeps its symmetric difference to
   that pivot.  Two sets link exactly when their differences overlap enough, so
   the same prefix join runs over the differences, which are short, and in which
   what the group shares is gone; no pair of a group is written out unless its
   differences leave room for a link.
6. the pairs found are verified in full.

Sets are identified by 64 bits of a digest; two different sets share one with
probability n^2 / 2^65.

Defined cases: a null or empty text, or one of white space only, has an empty
set, links with nothing and is its own component.  Fewer than five words: the
whole sequence is one shingle.  Repeated rows and equal sets share a component.
A null doc_id is a row of its own with component_id null unless linked.  Other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import common as C

K = 5
#: Jaccard threshold 0.8 as NUM / DEN.
NUM, DEN = 4, 5
SKETCH_BITS = 22
SLICES = 64
MARK_BITS = 26
#: Entries a task holds before it hands them on.
FLUSH_ROWS = 500_000
#: Postings of one bucket of the index, on average.
BUCKET_ROWS = 1_500_000
#: Lists up to this length give their pairs; sets in many longer ones are joined through differences to a pivot.
HOT_LIST = 64
#: Lists up to this length are pruned by position entry by entry; longer ones pass whole.
SHORT_LIST = 24
#: Tokens that a difference is taken to hold, for the number of files only.
DELTA = 50
_POST = np.dtype([("t", "<u8"), ("s", "<i8"), ("n", "<u2"), ("p", "<u2")])


def _sets(batch: pa.RecordBatch):
    """Yield (first row, end row, distinct hashes, rows, set sizes, digests) by slices of a batch."""
    raw, off = C.string_buffers(batch.column("text"))
    for i, j in C.row_slices(off):
        o = off[i:j + 1]
        h, _, _, first = C.words_of(raw[o[0]:o[-1]], o - o[0])
        s, row, _ = C.shingles_of(h, first, K)
        s, row = C.distinct_per_row(s, row)
        n = np.bincount(row, minlength=j - i)
        at = np.concatenate(([0], np.cumsum(n)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix64(s ^ np.uint64(0x5851F42D4C957F2D)))))
        digest = C.mix64(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)
        yield i, j, s, row, n, digest


def _scan(batches):
    """Rows of (doc_id, text_id, n_shingles, set_id), and at the end the task's counters in slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()),
                        ("part", pa.int32()), ("blob", pa.binary())])
    any_rows, held, size = False, [], 0

    def count():
        if held:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            counts[at] += n.astype(np.uint32)
            held.clear()

    for b in batches:
        for i, j, s, _, n, digest in _sets(b):
            any_rows = True
            held.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint32))
            size += len(s)
            if size >= FLUSH_ROWS:
                count()
                size = 0
            m = j - i
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, m).cast(pa.int64()), b.column("text_id").slice(i, m),
                                              pa.array(n.astype(np.int64)), pa.array(digest),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
    count()
    if any_rows:
        for k, part in enumerate(np.split(counts, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [
                pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=schema)


def _add_up(key, table):
    """Sum one slice of the counters over all tasks; log2 levels as bytes."""
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
    for x in table.column("blob"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    level = np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                    names=["part", "blob"])


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUM * n + DEN - 1) // DEN + 1


def _post(levels, n_buckets: int, hot_level: int):
    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()
        held, held_rows = [], 0

        def flush():
            if not held:
                return
            x, bucket, hot = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            o = np.lexsort((hot, bucket))
            x, bucket, hot = x[o], bucket[o], hot[o]
            cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (hot[1:] != hot[:-1]))))
            ends = np.append(cut[1:], len(x))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[cut].astype(np.int32)), pa.array(hot[cut]),
                pa.array([x[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], names=["bucket", "hot", "blob"])

        for b in batches:
            for i, j, s, row, n, digest in _sets(b):
                fresh = np.zeros(j - i, bool)
                for r, d in enumerate(digest.tolist()):
                    if n[r] and d not in seen:
                        seen.add(d)
                        fresh[r] = True
                use = fresh[row]
                s, row = s[use], row[use]
                lv = level[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
                t = (lv << np.uint64(58)) | (s >> np.uint64(6))
                o = np.lexsort((t, row))
                t, row, lv = t[o], row[o], lv[o]
                at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=j - i))))
                pos = np.arange(len(t)) - at[row]
                use = pos < prefix_length(n)[row]
                t, row, pos, lv = t[use], row[use], pos[use], lv[use]
                x = np.empty(len(t), _POST)
                x["t"], x["s"] = t, digest[row]
                x["n"], x["p"] = np.minimum(n[row], 65535), np.minimum(pos, 65535)
                hot = lv >= hot_level
                where = np.where(hot, C.mix64(x["s"].view(np.uint64)), C.mix64(t)) % np.uint64(n_buckets)
                held.append((x, where.astype(np.int64), hot))
                held_rows += len(x)
                if held_rows >= FLUSH_ROWS:
                    yield from flush()
                    held_rows = 0
        yield from flush()
    return run


def _shared(batches):
    """Of one partition of buckets: the entries of lists with two different sets or more.

    Hot shingles are spread by set, so they pass as they are (a superset is safe).
    """
    schema = pa.schema([("token", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def out(x):
        for k in range(0, len(x), 200_000):
            y = x[k:k + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(y["t"].view(np.int64).copy()), pa.array(y["s"].copy()),
                                              pa.array(y["n"].astype(np.int32)), pa.array(y["p"].astype(np.int32))],
                                             schema=schema)
    held: list[np.ndarray] = []
    for b in batches:
        for hot, x in zip(b.column("hot").to_pylist(), b.column("blob")):
            x = np.frombuffer(x.as_py(), _POST)
            if hot:
                yield from out(x)
            else:
                held.append(x)
    if held:
        x = np.concatenate(held)
        held.clear()
        x = x[np.lexsort((x["s"], x["t"]))]
        new_t = np.ones(len(x), bool)
        new_t[1:] = x["t"][1:] != x["t"][:-1]
        once = new_t.copy()
        once[1:] |= x["s"][1:] != x["s"][:-1]
        x, new_t = x[once], new_t[once]
        run = np.cumsum(new_t) - 1
        size = np.bincount(run)[run]
        x, run, size = x[size > 1], run[size > 1], size[size > 1]
        yield from out(x[(size > SHORT_LIST) | _has_partner(x, run, int(min(SHORT_LIST, size.max(initial=1))))])


def _has_partner(x: np.ndarray, run: np.ndarray, longest: int) -> np.ndarray:
    """Entries of short lists for which size and position leave some partner in the list."""
    keep = np.zeros(len(x), bool)
    n, rest = x["n"].astype(np.int64), x["n"].astype(np.int64) - x["p"]
    for k in range(1, longest):
        a, b = slice(0, len(x) - k), slice(k, len(x))
        fits = (np.minimum(n[a], n[b]) * DEN >= np.maximum(n[a], n[b]) * NUM) & \
            ((np.minimum(rest[a], rest[b]) + np.minimum(n[a] - rest[a], n[b] - rest[b])) * (NUM + DEN) >= (n[a] + n[b]) * NUM)
        fits = (run[a] == run[b]) & (fits | (n[a] == 65535) | (n[b] == 65535))
        keep[a] |= fits
        keep[b] |= fits
    return keep


def _tokens(bitmap):
    """(set_id, tokens) of the rows whose bit is set, tokens as signed hashes; a set is given once by a task.

    Bit test and sets are one step, so a task has one Python worker.
    """
    schema = pa.schema([("set_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        seen: set[int] = set()
        keys: set[int] = set()
        for b in batches:
            at = b.column("bit").to_numpy(zero_copy_only=False)
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            doc_id = b.column("doc_id")
            if doc_id.null_count:  # of the rows without doc_id one for each key will do
                for r in np.flatnonzero(keep & doc_id.is_null().to_numpy(zero_copy_only=False)).tolist():
                    key = b.column("key")[r].as_py()
                    keep[r] = key not in keys
                    keys.add(key)
            if not keep.any():
                continue
            for i, j, s, row, n, digest in _sets(b.filter(pa.array(keep))):
                fresh = np.zeros(j - i, bool)
                for r, d in enumerate(digest.tolist()):
                    fresh[r] = d not in seen
                    seen.add(d)
                off = np.concatenate(([0], np.cumsum(n[fresh]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digest[fresh]), pa.ListArray.from_arrays(
                    pa.array(off), pa.array(s[fresh[row]].view(np.int64)))], schema=schema)
    return run


def _bitmap_bits(n: int) -> int:
    """Bits of a bitmap for ``n`` keys: 32 a key and more, between 2^20 and 2^MARK_BITS (8 MB, whatever the input)."""
    return 1 << min(max((32 * n).bit_length(), 20), MARK_BITS)


def _bitmap(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """(k, bits): the bitmap of the keys in pieces of 4096 bytes, k from 1."""
    return keys.select((_bit(columns, bits) + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))


def _bit(columns: list[str], bits: int):
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def _sets_of(src: DataFrame, ids: DataFrame, n_ids: int) -> tuple[DataFrame, Broadcast]:
    """(set_id, tokens) of the rows of ``src`` whose key (doc_id, text_id where that is null) is in ``ids``, and of a few others;
    the bitmap, to be destroyed when they were read.

    A bitmap drops the other rows before their sets are made, so no text is
    shuffled.  Rows that share a bit with a wanted key pass: their sets are
    joined by no pair.
    """
    bits = _bitmap_bits(n_ids)
    whole = bytearray(bits >> 3)
    for r in _bitmap(ids, ["key"], bits).toLocalIterator():
        whole[(r["k"] - 1) * 4096:r["k"] * 4096] = r["bits"]
    shared = src.sparkSession.sparkContext.broadcast(bytes(whole))
    rows = src.select("doc_id", "text", F.coalesce("doc_id", "text_id").alias("key")).withColumn("bit", _bit(["key"], bits))
    return rows.mapInArrow(_tokens(shared), "set_id long, tokens array<long>"), shared


def _possible(x: str, y: str):
    """Whether sizes and positions of a shared prefix shingle leave room for the needed overlap.

    At most min(pos) shared shingles come before it, at most the shorter rest
    from it on.  65535 stands for "not known" and passes.
    """
    nx, ny, px, py = (F.col(f"{c}.{f}").cast("long") for f in ("n", "pos") for c in (x, y))
    known = (nx < 65535) & (ny < 65535)
    room = F.least(nx - px, ny - py) + F.least(px, py)
    return ~known | ((F.least(nx, ny) * DEN >= F.greatest(nx, ny) * NUM) & (room * (NUM + DEN) >= (nx + ny) * NUM))


def _enough(shared: str, nx: str, ny: str):
    """Whether two prefixes share as many shingles as linked sets must (an expression in ``shared``).

    Of the needed overlap o = ceil(0.8 / 1.8 (nx + ny)), the k-th shared shingle
    stands at position k + n - o or before, so the first
    o - ceil(0.8 max(nx, ny)) + 1 of them lie in both prefixes.
    """
    nx, ny = f"cast({nx} AS long)", f"cast({ny} AS long)"
    need = F.expr(f"({NUM} * ({nx} + {ny}) + {NUM + DEN - 1}) div {NUM + DEN} - ({NUM} * greatest({nx}, {ny}) + {DEN - 1}) div {DEN} + 1")
    return F.expr(f"greatest({nx}, {ny}) >= 65535") | (F.expr(shared) >= need)


def _with_sets(pairs: DataFrame, src: DataFrame, row_of: DataFrame) -> tuple[DataFrame, int, Callable[[], None]]:
    """``pairs`` (a, b) with the tokens ta and tb of their sets; only these sets are made again.  The number of pairs
    comes with them, and what frees the pairs and the bitmap of their rows when the result is written."""
    pairs = pairs.select("a", "b").persist(StorageLevel.DISK_ONLY)      # read by each of the steps below
    n_pairs = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(row_of, "set_id").select("key")
    sets, shared = _sets_of(src, ids, 2 * n_pairs)
    # Tasks may give a set more than once (repeated rows).  Both joins read the one shuffle of this grouping.
    sets = sets.groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    # Sorted on both sides at every size: the sets are no data to broadcast.
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")).hint("merge"), "a") \
        .join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")).hint("merge"), "b")

    def free():
        shared.destroy()
        pairs.unpersist()

    return both, n_pairs, free


def _verify(pairs: DataFrame, src: DataFrame, row_of: DataFrame, name: str) -> DataFrame:
    """(a, b, d, linked) with the exact Jaccard distance d of each pair."""
    both, n_pairs, free = _with_sets(pairs, src, row_of)
    out = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    union = F.col("na") + F.col("nb") - F.col("both")
    out = C.materialize(out.select("a", "b", (F.lit(1.0) - F.col("both") / union).alias("d"),
                                   (F.col("both") * DEN >= union * NUM).alias("linked")), f"op1-{name}", n_pairs)
    free()
    return out


def ngram_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and set_id of every row of ``docs``.

     See the module docstring
    for the method and the defined cases.
    """
    return _joined(docs, text_col, id_col).select("doc_id", "n_shingles", "component_id", "set_id")


def _joined(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ngram_join with text_id (a hash of the text) and component (null without words)."""
    spark = docs.sparkSession
    C.prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("text_id", _text_id("text"))
    scan = C.materialize(src.mapInArrow(_scan, "doc_id long, text_id long, n_shingles long, set_id long, part int, blob binary"), "op1-scan")
    doc = scan.where("part is null").select("doc_id", "text_id", "n_shingles", "set_id")
    comp, more = links(spark, src, scan, doc)
    # The later links join components of the earlier ones: the smallest set of both is the smallest of the smallest.
    between = _of_components(_of_components(more, comp, "a", "x"), comp, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = C.connected_components(between, name="op1-cc2", rows=more.count())
    first = comp.unionByName(joined.select("node", F.col("node").alias("component")).join(comp.select("node"), "node", "left_anti"))
    return with_components(doc, _of_components(first, joined, "component", "to").select("node", F.col("to").alias("component")))


def _text_id(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def with_components(doc: DataFrame, comp: DataFrame) -> DataFrame:
    """component and component_id of every document: the smallest doc_id of its component of sets."""
    sets = doc.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    sets = sets.join(comp.select(F.col("node").alias("set_id"), "component"), "set_id", "left") \
        .withColumn("component", F.coalesce("component", "set_id"))
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = sets.join(least, "component").select("set_id", "component", "component_id")
    return doc.join(of_set, "set_id", "left") \
        .select("doc_id", "text_id", "n_shingles",
                F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                "set_id", "component")


def links(spark: SparkSession, src: DataFrame, scan: DataFrame, doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components of the links found by pivots, edges (a, b) of the rest): together they have the components of all links."""
    with C.shuffles_freed(spark):
        level_rows = scan.where("part is not null").select("part", "blob").groupBy("part") \
            .applyInArrow(_add_up, "part int, blob binary").collect()  # 64 rows of 64 KB, whatever the input
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = (1 << SKETCH_BITS) // SLICES
    for r in level_rows:
        levels[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["blob"], np.uint8)
    total = doc.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (1 - NUM / DEN) / BUCKET_ROWS) + 1)
    hot_level = int(np.ceil(np.log2(total / (1 << SKETCH_BITS) + 65536)))
    shared_levels = spark.sparkContext.broadcast(levels.tobytes())

    posted = src.mapInArrow(_post(shared_levels, n_buckets, hot_level), "bucket int, hot boolean, blob binary") \
        .repartition(n_buckets, "bucket")
    alive = C.materialize(posted.mapInArrow(_shared, "token long, set_id long, n int, pos int"), "op1-lists")
    shared_levels.destroy()
    row_of = doc.groupBy("set_id").agg(F.coalesce(F.min("doc_id"), F.min("text_id")).alias("key"))

    # Answers by pivot: one candidate for each set, the pivot that it shares most prefix shingles with.
    entry = F.struct("pos", "n", "set_id")
    pivot = alive.groupBy("token").agg(F.min(entry).alias("q"))
    near = alive.select("token", "set_id", entry.alias("e")).join(pivot, "token") \
        .where("set_id <> q.set_id").where(_possible("e", "q")) \
        .groupBy("set_id", F.col("q.set_id").alias("pivot"), F.col("e.n").alias("n"), F.col("q.n").alias("m")) \
        .agg(F.count(F.lit(1)).alias("shared")).where(_enough("shared", "n", "m")) \
        .groupBy("set_id").agg(F.max(F.struct("shared", "pivot")).alias("best")) \
        .select(F.least("set_id", "best.pivot").alias("a"), F.greatest("set_id", "best.pivot").alias("b")).distinct()
    checked = _verify(near, src, row_of, "pivots")
    comp = C.connected_components(checked.where("linked").select("a", "b"), name="op1-cc1", rows=checked.count())
    known = _of_components(alive, comp)
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")) \
        .where("lo <> hi").select("token", "k")
    mixed = C.materialize(mixed, "op1-mixed", alive.count() // 2)      # lists of two sets or more
    short = known.join(mixed.where(F.col("k") <= HOT_LIST), "token", "left_semi")
    n_long = mixed.where(F.col("k") > HOT_LIST).agg(F.sum("k")).first()[0] or 0
    edges = None
    if not n_long:
        pairs = _not_far(_between(short.withColumn("held", F.lit(0))), checked)
    else:
        long = C.materialize(known.join(mixed.where(F.col("k") > HOT_LIST), "token", "left_semi"), "op1-long", n_long)
        held = long.groupBy("set_id").agg(F.count(F.lit(1)).alias("held"))
        long = long.join(held, "set_id").withColumn("dense", _enough("held", "n", "n"))
        apart = _differences(long.where("dense").select("token", "set_id"), src, row_of)
        edges = apart.where("linked").select("a", "b")
        counted = _between(short.join(held, "set_id", "left").withColumn("held", F.coalesce("held", F.lit(0))))
        pairs = _not_far(counted, checked).unionByName(_sparse(long)).unionByName(_by_difference(apart, comp)).distinct()
    rest = _verify(pairs, src, row_of, "rest").where("linked").select("a", "b")
    return comp, rest if edges is None else rest.unionByName(edges)


def _of_components(sets: DataFrame, comp: DataFrame, key: str = "set_id", out: str = "component") -> DataFrame:
    """``sets`` with the component of the set in ``key`` (the set itself where it has no link)."""
    return sets.join(comp.select(F.col("node").alias(key), F.col("component").alias(out)), key, "left") \
        .withColumn(out, F.coalesce(out, key))


def _differences(long: DataFrame, src: DataFrame, row_of: DataFrame) -> DataFrame:
    """(a, b, n, delta, linked): each set b of the lists with the pivot a of a list that holds it,
    its size and its symmetric difference to the pivot.

    A list's pivot is that of its sets which most lists hold, so the lists
    of one group of near copies have few pivots.
    """
    held = long.groupBy("set_id").agg(F.count(F.lit(1)).alias("lists"))
    pivots = long.join(held, "set_id").groupBy("token").agg(F.max(F.struct("lists", "set_id")).alias("q"))
    pairs = long.join(pivots, "token").where("set_id <> q.set_id").select(F.col("q.set_id").alias("a"), F.col("set_id").alias("b")).distinct()
    both, n_pairs, free = _with_sets(pairs, src, row_of)
    delta = F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta"))
    out = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("n"), delta.alias("delta"))
    # Linked: |A n B| >= 0.8 |A u B|, in terms of the symmetric difference.
    linked = F.size("delta") * (NUM + DEN) <= (F.col("na") + F.col("n")) * (DEN - NUM)
    out = C.materialize(out.select("a", "b", "n", "delta", linked.alias("linked")), "op1-apart", DELTA * n_pairs)
    free()
    return out


def _by_difference(apart: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components with one pivot, not both linked with it, whose
    differences can overlap enough.

    |x - y| = |dx| + |dy| - 2 |dx n dy| (symmetric differences) must be at most
    (nx + ny) / 9, so the differences must share c = ceil((|dx| + |dy| -
    (nx + ny) div 9) / 2) tokens.  c is at least 1, as sets for which it is not
    are both linked with the pivot.  Tokens are ordered by
    their number among the pivot's differences, rare ones first; the first
    shared one must leave room for c.
    """
    sets = _of_components(apart.select(F.col("a").alias("q"), F.col("b").alias("s"), "n", "delta", "linked"), comp, "s")
    sized = sets.withColumn("m", F.size("delta"))
    least = sized.groupBy("q").agg(F.min("m").alias("m0"), F.max("n").alias("n1"))
    tokens = sized.join(least, "q").select("q", "s", "component", "linked", "n", "m", "m0", "n1", F.explode("delta").alias("t"))
    often = tokens.groupBy("q", "t").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("q", "s").orderBy("f", "t")
    placed = tokens.join(often, ["q", "t"]).withColumn("i", F.row_number().over(order) - 1)
    # No partner has a smaller difference than m0 or more than n1 shingles: what stands later cannot be a first shared token.
    room = F.expr(f"m - (m + m0 - (n + n1) * {DEN - NUM} div {NUM + DEN} + 1) div 2")
    post = placed.where(F.col("f") > 1).where(F.col("i") <= room).select("q", "t", F.struct("s", "component", "linked", "n", "m", "i").alias("e"))
    x, y = post.withColumnRenamed("e", "x"), post.withColumnRenamed("e", "y")
    c = F.expr(f"(x.m + y.m - (x.n + y.n) * {DEN - NUM} div {NUM + DEN} + 1) div 2")
    return x.join(y, ["q", "t"]).where("x.component < y.component AND NOT (x.linked AND y.linked)").where(F.least(F.expr("x.m - x.i"), F.expr("y.m - y.i")) >= c) \
        .select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()


def _between(short: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that share enough shingles of short lists.

    ``held``: the long lists that a set is in, which two sets may share besides.
    """
    blocks = short.groupBy("token", "component", "n", "pos").agg(F.collect_list(F.struct("set_id", "held")).alias("members"))
    x = blocks.select("token", F.struct("component", "n", "pos", "members").alias("x"))
    y = blocks.select("token", F.struct("component", "n", "pos", "members").alias("y"))
    return x.join(y, "token").where("x.component < y.component").where(_possible("x", "y")) \
        .select(F.explode("x.members").alias("u"), "y.members", F.col("x.n").alias("n"), F.col("y.n").alias("m")) \
        .select("u", F.explode("members").alias("v"), "n", "m") \
        .groupBy(F.col("u.set_id").alias("u"), F.col("v.set_id").alias("v"), "n", "m") \
        .agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("u.held", "v.held")).alias("held")) \
        .where(_enough("shared + held", "n", "m")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _sparse(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that share enough shingles of long lists, one of them
    at least in few.

    A set is dense where it is in as many long lists as it must share with a
    linked set of its own size.  What a group of near copies shares makes its
    sets dense; one line that many texts hold does not, and a set in few long
    lists can only link with sets of quite another size, or through short lists.
    """
    x = long.select("token", F.struct("component", "set_id", "n", "pos", "held", "dense").alias("x")).where("NOT x.dense")
    y = long.select("token", F.struct("component", "set_id", "n", "pos", "held", "dense").alias("y"))
    return x.join(y, "token").where("x.component <> y.component AND (y.dense OR x.set_id < y.set_id)") \
        .where(_enough("least(x.held, y.held)", "x.n", "y.n")).where(_possible("x", "y")) \
        .groupBy(F.col("x.set_id").alias("u"), F.col("y.set_id").alias("v"), F.col("x.n").alias("n"), F.col("y.n").alias("m")) \
        .agg(F.count(F.lit(1)).alias("shared")).where(_enough("shared", "n", "m")) \
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _not_far(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """The pairs that are neither checked nor ruled out by the distances to a pivot of both."""
    pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    # Distances to a pivot that both sets were verified with.
    to = checked.select(F.col("a").alias("s"), F.col("b").alias("p"), "d") \
        .unionByName(checked.select(F.col("b").alias("s"), F.col("a").alias("p"), "d"))
    own = to.groupBy("s").agg(F.min(F.struct("d", "p")).alias("best")).select("s", "best.p", "best.d")
    far = pairs.join(own.select(F.col("s").alias("a"), "p", F.col("d").alias("da")), "a") \
        .join(to.select(F.col("s").alias("b"), "p", F.col("d").alias("db")), ["b", "p"]) \
        .where(F.abs(F.col("da") - F.col("db")) > 1 - NUM / DEN + 1e-9).select("a", "b").distinct()
    return pairs.join(far, ["a", "b"], "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest doc_id.

    Rows without words all stay.  Rows that share a doc_id and a text are one
    document.  Of a group without any doc_id, and of different linked texts under
    the smallest doc_id, the one with the smallest hash stays.
    """
    found = C.materialize(_joined(docs).select("doc_id", "text_id", "n_shingles", "component"), "op1-found", docs.count())
    first = found.where("n_shingles > 0").groupBy("component") \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("f"))
    keep = first.select("f.doc_id", "f.text_id") \
        .unionByName(found.where("n_shingles = 0").select("doc_id", "text_id"))
    # Keys of rows that go or come more than once: only rows that share a bit with one of these are shuffled with their texts.
    # Those that go are named, as rows that share a bit must stay.
    marked = found.select("doc_id", "text_id", F.lit(1).alias("n"), F.lit(0).alias("stays")) \
        .unionByName(keep.select("doc_id", "text_id", F.lit(0).alias("n"), F.lit(1).alias("stays"))) \
        .groupBy("doc_id", "text_id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays"))
    marked = C.materialize(marked.where("n > 1 OR stays = 0").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), "stays"), "op1-marked",
                           found.count())
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("_id"), _text_id("text").alias("_text"))
    bits = _bitmap_bits(marked.count())
    bit = _bit(["_id", "_text"], bits)
    pieces = F.broadcast(_bitmap(marked, ["_id", "_text"], bits))
    is_marked = F.expr("shiftright(cast(conv(hex(substring(bits, cast(_bit % 32768 div 8 + 1 AS int), 1)), 16, 10) AS int), cast(_bit % 8 AS int)) & 1 = 1")
    tested = rows.withColumn("_bit", bit).join(pieces, F.expr("_bit div 32768 + 1") == F.col("k"), "left") \
        .select("_row", "_id", "_text", F.coalesce(is_marked, F.lit(False)).alias("_marked"))
    stay = marked.select(F.col("_id").alias("_keep"), F.col("_text").alias("_keep_text"), F.col("stays").alias("_stays"))
    rest = tested.where("_marked") \
        .join(stay.where("_stays = 0"), F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_keep_text")), "left_anti") \
        .dropDuplicates(["_id", "_text"])
    return tested.where("NOT _marked").select("_row.*").unionByName(rest.select("_row.*"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(C.load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
