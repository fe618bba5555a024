"""Sharding along a Hilbert curve (DataFrame functions only).

Metadata dimensions (source, lang, size and doc_id order) are quantised to
2^BITS cells each by quantile edges (of strings: the whole strings, ranked over
the table of distinct values), the cell's Hilbert index orders the rows,
and the order is cut into runs of equal row counts: neighbours on the curve
are neighbours in every dimension, so the files of a shard have narrow ranges
in all of them and can be pruned by any.

Law ``rows``: shard sizes are at most one row apart.  Groups of equal texts
take the dimensions of their first document (smallest doc_id), so a group is
one run of the order; it is split only where a cut falls inside it.

The global rank needs no single sorted partition: rows are dealt by range over
(curve, text hash, doc_id), which also splits a hot group, counted per
partition, and numbered inside each partition on top of the counts before it.

Defined cases: a null text counts as empty (size 16, crc32 0), a null in
another column sorts as the lowest value.  Equal rows are separate rows.  With
fewer rows than shards some shards are empty.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import common as C

SHARDS = 40
BITS = 4


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def hilbert_index(cells: list[str], bits: int) -> Column:
    """Hilbert index of integer columns with ``bits`` bits each (Hamilton's entry/direction form).

    Two steps for each bit level: rotate the level's bits into the current
    orientation and undo the Gray code, then turn the orientation.
    """
    n = len(cells)
    size, mask = 1 << n, (1 << n) - 1
    trailing = [next(k for k in range(n + 1) if not i >> k & 1) for i in range(size)]
    inverse = sorted(range(size), key=_gray)
    entry = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(size)]
    turn = [0 if w == 0 else trailing[w if w & 1 else w - 1] % n for w in range(size)]
    pick = lambda table, at: f"element_at(array({', '.join(map(str, table))}), {at} + 1)"
    level = f"({bits - 1} - i div 2)"
    corner = " | ".join(f"shiftleft(shiftright({c}, cast({level} as int)) & 1, {j})" for j, c in enumerate(cells))
    back = f"(((a.d + 1) % {n}))"
    turned = f"(({corner}) ^ a.e)"
    rotated = f"((shiftright({turned}, {back}) | shiftleft({turned}, {n} - {back})) & {mask})"
    gate = pick(entry, "a.w")
    opened = f"((shiftleft({gate}, {back}) | shiftright({gate}, {n} - {back})) & {mask})"
    make = "named_struct('h', cast({h} as bigint), 'e', cast({e} as int), 'd', cast({d} as int), 'w', cast({w} as int))".format
    first = make(h="a.h", e="a.e", d="a.d", w=pick(inverse, rotated))
    second = make(h=f"shiftleft(a.h, {n}) | a.w", e=f"a.e ^ {opened}", d=f"(a.d + {pick(turn, 'a.w')} + 1) % {n}", w="0")
    return F.expr(f"aggregate(sequence(0, {2 * bits - 1}), {make(h=0, e=0, d=0, w=0)}, "
                  f"(a, i) -> CASE WHEN i % 2 = 0 THEN {first} ELSE {second} END, a -> a.h)")


def _cumulative(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``rows`` with ``upto`` (running sum of ``weight`` in the order, the row included) and ``total``.

    Rows are dealt by range and written, so that numbers of partitions hold; their
    sums are a table of as many rows as partitions, whatever the input.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = C.materialize(rows.repartitionByRange(n_parts, *order).withColumn("pid", F.spark_partition_id()), name)
    per = dealt.groupBy("pid").agg(F.sum(weight).alias("s"))
    before = per.select("pid", (F.sum("s").over(Window.orderBy("pid")) - F.col("s")).alias("before"),
                        F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(before, "pid").withColumn("upto", F.col("before") + F.sum(weight).over(inside)).drop("pid", "before")


def string_edges(rows: DataFrame, col: str, bits: int) -> list[str]:
    """The values at which a new one of 2^bits cells of near equal counts begins."""
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    placed = _cumulative(counts, [col], "n", "op4-values")
    cells = 1 << bits
    starts = F.expr(f"upto * {cells} div total > (upto - n) * {cells} div total AND (upto - n) * {cells} div total < {cells - 1}")
    return sorted(r[0] for r in placed.where(starts).select(col).collect())       # at most 2^bits values


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a text hash and the numeric dimensions of each row, without the text."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    have = set(docs.columns)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("th"),
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in ("source", "lang")])


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row of ``docs``."""
    spark = docs.sparkSession
    rows = C.materialize(metadata(docs), "op4-meta")
    lead = rows.groupBy("th").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "source", "lang", "size")).alias("g"))
    strings, numbers = ("source", "lang"), ("size", "k")
    dims = strings + numbers
    grid = [k / (1 << bits) for k in range(1, 1 << bits)]
    groups = C.materialize(lead.select("th", *[F.col(f"g.{d}").alias(d) for d in dims]), "op4-groups")
    edges = groups.agg(*[F.percentile_approx(F.col(d).cast("double"), grid, 10_000).alias(d) for d in numbers]).first().asDict()
    edges = {d: [float(x) for x in v or [0.0]] for d, v in edges.items()} | {d: string_edges(groups, d, bits) or [""] for d in strings}

    def cell(d: str) -> Column:
        at = F.array(*[F.lit(x) for x in edges[d]])
        return F.size(F.filter(at, lambda x: x <= (F.col(d) if d in strings else F.col(d).cast("double")))).cast("int")

    # At most 2^bits edges are at or below a value: the last cell takes the rest.
    curve = groups.select("th", *[F.least(cell(d), F.lit((1 << bits) - 1)).alias(f"c_{d}") for d in dims]) \
        .select("th", hilbert_index([f"c_{d}" for d in dims], bits).alias("curve"))
    placed = rows.join(curve, "th").select("doc_id", "size", "text_crc32", "th", "curve", F.lit(1).cast("long").alias("one"))
    ranked = _cumulative(placed, ["curve", "th", "doc_id"], "one", "op4-runs") \
        .withColumn("rank", F.col("upto") - 1).withColumn("shard", F.expr(f"rank * {shards} div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                         F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as shard=/run= folders in slot order; doc_id must be unique here."""
    at = assigned.select("doc_id", F.col("shard"), "slot", F.expr(f"slot div {rows_per_file}").alias("run"))
    docs.join(at, "doc_id").repartition("shard", "run").sortWithinPartitions("shard", "run", "slot") \
        .write.partitionBy("shard", "run").parquet(path)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(C.load(spark, sf_dir, "documents"))
