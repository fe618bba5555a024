"""Document fingerprints: 64-bit SimHash with permuted block tables (DataFrame functions only).

A text's terms are its word triples (white-space words, lower case), one for
each word position; at the end they are shorter.  A term's 64-bit hash votes
on each bit, for or against, with the weight of its first word (its length up
to 16), and repeats vote again.  The votes are summed by a grouped aggregate over
exploded terms, two 32-bit lanes in each of 32 sums.

``search`` finds all fingerprints within RADIUS bits of a query: 64 bits are
cut into 6 blocks, and each of the 20 choices of 3 blocks is a table keyed by
these bits.  At most 3 differing bits leave 3 blocks alike, so no match is
lost.  Equal fingerprints are one entry with a row count, so copies make no pairs.

Defined cases: null text is empty; an empty text has fingerprint 0; equal texts
have equal fingerprints.  A null doc_id sorts first.  For a repeated doc_id
each row keeps its own text, the next document is the next different doc_id,
and of several texts there the smallest head is taken.  A single
document is its own next one.  An empty table gives no rows.  A text may hold
up to 2^27 words (a lane's bound).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import common as C

RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
QUERY_STEP = 20
_LANES = 0x0000000100000001
_FIRST = -(1 << 63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def table_masks(radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> list[int]:
    """Bit masks of all tables: each keeps len(blocks) - radius blocks."""
    starts = [sum(blocks[:k]) for k in range(len(blocks))]
    masks = [((1 << n) - 1) << s for n, s in zip(blocks, starts)]
    return [_signed(sum(c)) for c in combinations(masks, len(blocks) - radius)]


def _votes() -> list[Column]:
    w = F.col("t.w").cast("long")
    return [F.sum(F.shiftrightunsigned(F.col("t.h"), j).bitwiseAND(F.lit(_LANES)) * w).alias(f"v{j}")
            for j in range(32)] + [F.sum(w).alias("w")]


def _fingerprint() -> Column:
    """The bits for which more than half of the weight voted; 0 without terms."""
    bits = []
    for j in range(64):
        lane = F.col(f"v{j % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if j < 32 else F.shiftrightunsigned(F.col(f"v{j % 32}"), 32)
        bits.append(F.when(lane * 2 > F.col("w"), F.lit(_signed(1 << j))).otherwise(F.lit(0).cast("long")))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.coalesce(out, F.lit(0).cast("long"))


def simhash(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and fp (long): the fingerprint of each row's whole text; keys must tell rows apart."""
    words = rows.withColumn("ws", F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[ \t-\r]+"),
                                           lambda x: x != ""))
    triple = F.transform("ws", lambda x, i: F.struct(
        F.xxhash64(x, F.get("ws", i + 1), F.get("ws", i + 2)).alias("h"),
        F.least(F.length(x), F.lit(16)).alias("w")))
    terms = words.select(*keys, triple.alias("ts")).select(*keys, F.explode_outer("ts").alias("t"))
    return terms.groupBy(*keys).agg(*_votes()).select(*keys, _fingerprint().alias("fp"))


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def as_hex(c: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def search(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(fp, n_near): for each different query fingerprint, the rows of ``index`` within ``radius`` bits.

    Both frames hold fp; ``index`` is counted by fingerprint first.  A pair that
    several tables find counts at the first one.
    """
    masks = table_masks(radius, blocks)
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                 for k, m in enumerate(masks)])).alias("e")
    q = queries.select("fp").distinct().select(F.col("fp").alias("qf"), tables).select("qf", "e.t", "e.key")
    i = index.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select("n", F.col("fp").alias("xf"), tables) \
        .select("n", "xf", "e.t", "e.key")
    diff = F.col("qf").bitwiseXOR(F.col("xf"))
    at = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    # Hits at all radii are a superset of the pairs: the bit count and the first-table rule decide.
    # A merge join: the tables are twenty times the fingerprints that Spark would judge a broadcast by.
    hits = q.withColumnRenamed("t", "qt").withColumnRenamed("key", "qk").hint("merge") \
        .join(i, (F.col("qk") == F.col("key")) & (F.col("qt") == F.col("t"))
              & (F.bit_count(diff) <= radius) & (at == F.col("t")))
    return hits.groupBy(F.col("qf").alias("fp")).agg(F.sum("n").alias("n_near"))


def successors(docs: DataFrame) -> DataFrame:
    """key, next_key, prev_key, need: the order of different keys as a ring.

    ``need`` is the number of leading code points that the key before asks for.
    Keys are dealt by range; only the first and last of each partition meet.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("key").agg(F.max("n").alias("n"))
    dealt = C.materialize(ids.repartitionByRange(n_parts, "key").withColumn("pid", F.spark_partition_id()), "op9-ids")
    ends = dealt.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max_by("n", "key").alias("hi_n"))
    whole, order = Window.partitionBy(), Window.orderBy("pid")
    ends = ends.select("pid",
                       F.coalesce(F.lead("lo").over(order), F.min("lo").over(whole)).alias("after"),
                       F.coalesce(F.lag("hi").over(order), F.max("hi").over(whole)).alias("before"),
                       F.coalesce(F.lag("hi_n").over(order), F.max_by("hi_n", "pid").over(whole)).alias("before_n"))
    w = Window.partitionBy("pid").orderBy("key")
    return dealt.withColumn("nk", F.lead("key").over(w)).withColumn("pk", F.lag("key").over(w)) \
        .withColumn("pn", F.lag("n").over(w)).join(ends, "pid") \
        .select("key", F.coalesce("nk", "after").alias("next_key"), F.coalesce("pk", "before").alias("prev_key"),
                F.expr("coalesce(pn, before_n) div 4").alias("need"))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of every row (fingerprints as longs)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    src = src.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST)).alias("key"), "text", F.char_length("text").cast("long").alias("n"))
    ring = C.materialize(successors(src), "op9-ring")
    # Both uses of the texts need the same columns, so one shuffle by key serves both.
    joined = src.select("key", "text").join(ring, "key")
    heads = joined.select("prev_key", F.substring(F.col("text"), F.lit(1), F.col("need").cast("int")).alias("head")) \
        .groupBy("prev_key").agg(F.min("head").alias("head")).withColumnRenamed("prev_key", "key")
    rows = joined.select("key", F.nullif(F.col("key"), F.lit(_FIRST)).alias("doc_id"), "next_key", "text").join(heads, "key") \
        .withColumn("row", F.monotonically_increasing_id()) \
        .withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.expr("n_chars div 4").cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("cut")),
                      F.substring(F.col("head"), F.lit(1), F.col("cut")))
    rows = rows.select("key", "row", "doc_id", "next_key", "n_chars", "text", edited.alias("edited")) \
        .withColumn("sha", F.sha2("edited", 256))
    both = rows.select("key", "row", "doc_id", "next_key", "n_chars", "sha",
                       F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text")),
                                         F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("v")) \
        .select("key", "row", "doc_id", "next_key", "n_chars", "sha", "v.edit", "v.text")
    fp = simhash(both, ["key", "row", "doc_id", "next_key", "n_chars", "sha", "edit"])
    fp = fp.groupBy("key", "row", "doc_id", "next_key", "n_chars", "sha").agg(
        F.max(F.when(F.col("edit") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("edit") == 1, F.col("fp"))).alias("edited_fp"))
    fp = C.materialize(fp.drop("row"), "op9-fp")
    after = fp.groupBy("key").agg(F.min("fp").alias("next_fp")).withColumnRenamed("key", "next_key")
    return fp.join(after, "next_key").select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; n_near: for rows whose doc_id is divisible by 20 (the queries),
    how many rows of all have a fingerprint within 3 bits, itself included; else null."""
    fp = fingerprints(C.load(spark, sf_dir, "documents"))
    near = search(fp.where(F.col("doc_id") % QUERY_STEP == 0).select("fp"), fp.select("fp"))
    return fp.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % QUERY_STEP == 0, F.col("n_near")).alias("n_near"))
