"""Past-only behavioral features.

Semantics (reference): for row i of an entity, "past" is every row j of the
same entity that comes earlier in (date, id) order and has date >= date_i - w.
Earlier rows with an *equal* timestamp count ("row_order" ties); ``ties=
"strict"`` keeps only rows with date < date_i.

Plan of one entity: a narrow row (id, entity, instant, amount, attributes) goes
to its (entity, bucket) and, within the longest window of the bucket's end, to
the next bucket as context; one Exchange and one sort; a vectorised kernel
(``window_kernel``) computes all windows of many entities at once; the narrow
results are joined back to the wide rows by id.  The wide row is in no sort but
that join's.

Hot entities (more than ``hot_rows`` rows in one bucket) take another way, in
blocks shorter than the windows (``hot_block``): a task holds the rows of one
block and of the blocks in which a window can begin, and summaries of the blocks
between them (counts, sums, extremes, centred moments, distinct values), which
are grouped aggregates.  More rows of an entity are more or fuller blocks, never
one task.

Rows without entity or instant have constant features and enter no task.  The
id must be unique and not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import DEFAULT_WINDOWS, Z_EPS
from riskloom.functions.timecols import US_PER_DAY, US_PER_S, epoch_us, parse_window
from riskloom.operators import window_kernel as K
from riskloom.session import ship_package

HOT_ROWS = 1_000_000
HOT_BLOCK = "1h"


def _resolve_attr(df: DataFrame, spec: str | None, candidates: tuple[str, ...]) -> str | None:
    if spec == "auto":
        for c in candidates:
            if c in df.columns:
                return c
        return None
    return spec


def _contiguous(rows: DataFrame, spec: K.Spec) -> DataFrame:
    """Features by whole buckets of ``spec.span`` with context from the bucket before."""
    w_max, attrs = max(spec.lengths), list(spec.attrs)
    b = F.floor(F.col("us") / F.lit(spec.span)).cast("long")
    reaches = F.col("us") + F.lit(w_max) >= (F.col("own") + 1) * F.lit(spec.span)
    own = F.struct(F.col("own").alias("b"), F.lit(K.OWN).alias("kind"))
    after = F.struct((F.col("own") + 1).alias("b"), F.lit(K.CONTEXT).alias("kind"))
    staged = rows.withColumn("own", b) \
        .withColumn("to", F.explode(F.when(reaches, F.array(own, after)).otherwise(F.array(own)))) \
        .select("e", "to.b", "to.kind", "us", "id", "a", *attrs)
    if spec.recency:
        last = rows.groupBy("e", b.alias("b")).agg(F.max("us").alias("last"))
        before = Window.partitionBy("e").orderBy("b")
        carry = last.select("e", "b", F.lag("last").over(before).alias("us")).where("us is not null")
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "a", *attrs)]
        staged = staged.unionByName(carry.select("e", "b", F.lit(K.CARRY).alias("kind"), "us", *empty))
    return _run(staged, K.contiguous(spec), rows, spec)


def _run(staged: DataFrame, kernel, rows: DataFrame, spec: K.Spec) -> DataFrame:
    ship_package(rows.sparkSession)
    out = ", ".join(f"{n} {t}" for n, t in [("id", rows.schema["id"].dataType.simpleString()), *spec.fields()])
    return staged.repartition("e", "b").sortWithinPartitions("e", "b", "us", "id").mapInArrow(kernel, out)


def _blocked(rows: DataFrame, spec: K.Spec, block: int) -> DataFrame:
    """Features by blocks shorter than the windows, for entities of any size."""
    lengths, attrs = spec.lengths, list(spec.attrs)
    rows = rows.withColumn("b", F.floor(F.col("us") / F.lit(block)).cast("long"))
    blocks = rows.groupBy("e", "b").agg(
        F.count(F.lit(1)).alias("rows"), F.count("a").alias("n"), F.sum("a").alias("s"), F.max("a").alias("mx"), F.min("a").alias("mn"),
        F.avg("a").alias("avg"), F.var_pop("a").alias("var"), F.max("us").alias("last"),
        F.min(F.when(F.abs("a") < float("inf"), F.struct("us", "id", "a"))).alias("first"))
    of_entity = Window.partitionBy("e")
    by_block = of_entity.orderBy("b")
    blocks = blocks.withColumns({
        "centre": F.coalesce(F.min("first").over(of_entity)["a"], F.lit(0.0)),      # no later value may move a result
        "before": F.max("last").over(by_block.rowsBetween(Window.unboundedPreceding, -1))})
    off = F.col("avg") - F.col("centre")
    blocks = blocks.withColumns({"s1": F.col("n") * off, "s2": F.col("n") * (off * off + F.col("var"))})

    # Blocks that have a value, with the nearest ones before and after; the values a window's middle has.
    counts, middle = None, {k: w // block for k, w in enumerate(lengths) if w // block >= 2}
    for c in attrs:
        has = rows.where(F.col(c).isNotNull()).groupBy("e", c, "b").agg(F.count(F.lit(1)).alias("k")).drop("k")
        order = Window.partitionBy("e", c).orderBy("b")
        has = has.withColumns({f"{c}_pb": F.lag("b").over(order), f"{c}_nb": F.lead("b").over(order)})
        # A block stands for a value from the next block on, until the value comes again or the middle has passed.
        steps = []
        for k, q in middle.items():
            until = F.least(F.col(f"{c}_nb"), F.col("b") + F.lit(q - 1)) + 1
            steps += [F.struct((F.col("b") + 1).alias("x"), F.lit(f"{c}{k}").alias("of"), F.lit(1).alias("d")),
                      F.struct(until.alias("x"), F.lit(f"{c}{k}").alias("of"), F.lit(-1).alias("d"))]
        if steps:
            part = has.select("e", F.explode(F.array(*steps)).alias("t")).select("e", "t.x", "t.of", "t.d")
            counts = part if counts is None else counts.unionByName(part)
        rows = rows.join(has, ["e", c, "b"], "left")
    if counts is not None:
        of = [f"{c}{k}" for c in attrs for k in middle]
        marks = blocks.select("e", F.col("b").alias("x"), F.lit("").alias("of"), F.lit(0).alias("d"))
        at = counts.unionByName(marks).groupBy("e", "x").agg(*[F.sum(F.when(F.col("of") == x, F.col("d")).otherwise(0)).alias(x) for x in of])
        running = Window.partitionBy("e").orderBy("x")
        blocks = blocks.join(at.select("e", F.col("x").alias("b"), *[F.sum(x).over(running).alias(f"m_{x}") for x in of]), ["e", "b"])
    mid = [F.col("centre"), F.col("before")]
    for k in range(len(lengths)):
        if k in middle:
            over = by_block.rangeBetween(-(middle[k] - 1), -1)       # as many rows as blocks in a window, whatever they hold
            mid += [F.sum("rows").over(over), F.sum("n").over(over), F.sum("s").over(over), F.max("mx").over(over), F.min("mn").over(over),
                    F.sum("s1").over(over), F.sum("s2").over(over), *[F.col(f"m_{c}{k}") for c in attrs]]
        else:
            mid += [F.lit(None)] * (K.MID + len(attrs))
    summary = blocks.select("e", "b", F.lit(-1).alias("kind"), F.array(*[m.cast("double") for m in mid]).alias("mid"))

    back = sorted({0} | {d for w in lengths for d in K.offsets(w, block)})
    near = [f"{c}_{x}" for c in attrs for x in ("pb", "nb")]
    staged = rows.withColumn("kind", F.explode(F.array(*[F.lit(d) for d in back]))) \
        .select("e", (F.col("b") + F.col("kind")).alias("b"), "kind", "us", "id", "a", *attrs, *near, F.lit(None).cast("array<double>").alias("mid"))
    empty = [F.lit(None).cast(staged.schema[c].dataType).alias(c) for c in ("id", "a", *attrs, *near)]
    staged = staged.unionByName(summary.select("e", "b", "kind", F.lit(0).cast("long").alias("us"), *empty, "mid"))
    return _run(staged, K.blocked(spec, block), rows, spec)


def velocity_features(df: DataFrame, entity_col: str, prefix: str, *, date_col: str = "date", amount_col: str = "amount",
                      id_col: str = "id", merchant_col: str | None = "auto", mcc_col: str | None = "auto",
                      windows: dict[str, int | str] | None = None, ties: str = "row_order", bucket_factor: int = 1,
                      z_window: str | None = None, z_eps: float = Z_EPS, recency: bool = False,
                      hot_rows: int | None = HOT_ROWS, hot_block: int | str = HOT_BLOCK) -> tuple[DataFrame, dict[str, Column]]:
    """(narrow table, columns): the table has ``__fid`` and the features of the rows
    with entity and instant; ``columns`` maps each feature name to its expression
    after a left join by id (the constants of an empty past where no row joined).

    ``hot_rows``: rows of an entity in one bucket (``bucket_factor`` x the longest
    window) from which the entity goes by blocks of ``hot_block``; None: never.
    """
    if ties not in ("row_order", "strict"):
        raise ValueError("ties must be 'row_order' or 'strict'")
    wins = {k: parse_window(v) * US_PER_S for k, v in (windows or DEFAULT_WINDOWS).items()}
    z_us = parse_window(z_window) * US_PER_S if z_window else None
    lengths = sorted(set(wins.values()) | ({z_us} if z_us else set()))
    merch = _resolve_attr(df, merchant_col, ("merchant_id",))
    mcc = _resolve_attr(df, mcc_col, ("mcc_str", "mcc"))
    attrs = {k: v for k, v in {"um": (merch, "unique_merchants"), "uc": (mcc, "unique_mcc")}.items() if v[0]}
    spec = K.Spec(tuple(lengths), max(1, bucket_factor) * lengths[-1], tuple(attrs), ties == "strict",
                  lengths.index(z_us) if z_us else None, z_eps, recency)
    rows = df.select(F.col(id_col).alias("id"), F.col(entity_col).alias("e"), epoch_us(date_col).alias("us"),
                     F.col(amount_col).cast("double").alias("a"), *[F.col(v[0]).alias(k) for k, v in attrs.items()]) \
        .where(F.col("e").isNotNull() & F.col("us").isNotNull())

    found = None
    if hot_rows is not None:
        crowded = rows.groupBy("e", F.floor(F.col("us") / F.lit(spec.span)).alias("b")).agg(F.count(F.lit(1)).alias("n")) \
            .where(F.col("n") > hot_rows).select("e").distinct()
        if not crowded.isEmpty():
            hot = F.broadcast(crowded)          # at most one entity for each hot_rows rows of the table
            found = _blocked(rows.join(hot, "e", "left_semi"), spec, parse_window(hot_block) * US_PER_S)
            rows = rows.join(hot, "e", "left_anti")
    rest = _contiguous(rows, spec)
    found = rest if found is None else found.unionByName(rest)

    columns: dict[str, Column] = {}
    none = F.lit(0).cast("long")
    for label, w in wins.items():
        k = lengths.index(w)
        columns |= {f"{prefix}_tx_count_{label}": F.coalesce(f"__{prefix}_n{k}", none),
                    f"{prefix}_amount_sum_{label}": F.coalesce(f"__{prefix}_s{k}", F.lit(0.0)),
                    f"{prefix}_amount_mean_{label}": F.col(f"__{prefix}_m{k}"), f"{prefix}_amount_max_{label}": F.col(f"__{prefix}_x{k}")}
        columns |= {f"{prefix}_{name}_{label}": F.coalesce(f"__{prefix}_{c}{k}", none) for c, (_, name) in attrs.items()}
    if z_us:
        columns["z_score_amount"] = F.col(f"__{prefix}_z")
    if recency:
        columns[f"time_since_last_tx_{prefix}"] = F.col(f"__{prefix}_since")
    return found.select(F.col("id").alias("__fid"), *[F.col(n).alias(f"__{prefix}_{n}") for n, _ in spec.fields()]), columns


def attach_features(df: DataFrame, id_col: str, parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """``df`` with the features of ``parts``, joined by id (one sort of the wide rows for all of them)."""
    out, columns = df, {}
    for i, (narrow, cols) in enumerate(parts):
        out = out.join(narrow.withColumnRenamed("__fid", f"__fid{i}"), F.col(id_col) == F.col(f"__fid{i}"), "left")
        columns |= cols
    return out.select(*[df[c] for c in df.columns], *[c.alias(n) for n, c in columns.items()])


def add_velocity(df: DataFrame, entity_col: str, prefix: str, *, id_col: str = "id", **options) -> DataFrame:
    """W1-W7 (+ W10 z-score, + W8 recency) for one entity after one Exchange.

    Adds ``{prefix}_tx_count_{w}``, ``{prefix}_amount_sum_{w}``,
    ``{prefix}_amount_mean_{w}``, ``{prefix}_amount_max_{w}``,
    ``{prefix}_unique_merchants_{w}``, ``{prefix}_unique_mcc_{w}`` per window;
    ``z_score_amount`` when ``z_window`` is set; ``time_since_last_tx_{prefix}``
    when ``recency``.  Options: those of ``velocity_features``.
    Empty past: count 0, sum 0, mean/max NULL, unique 0, z NULL.  Rows without
    entity or instant: the same.
    """
    return attach_features(df, id_col, [velocity_features(df, entity_col, prefix, id_col=id_col, **options)])


def add_time_since_last_tx(df: DataFrame, entities=(("card_id", "card"), ("client_id", "user")),
                           *, date_col: str = "date", id_col: str = "id",
                           bucket_us: int = US_PER_DAY) -> DataFrame:
    """Seconds since the previous row of the same entity in (date, id)
    order; first row NULL; equal instants give 0.

    Computed as a running max of the earlier instants in two levels (per
    entity and day, then within the day), so a hot entity is split by day.
    """
    out = df.withColumn("__us", epoch_us(date_col)) \
        .withColumn("__day", F.floor(F.col("__us") / F.lit(bucket_us)).cast("long"))
    for entity, prefix in entities:
        if entity not in df.columns:
            continue
        out = _running_prev_max(out, entity, id_col, bucket_us) \
            .withColumn(f"time_since_last_tx_{prefix}",
                        F.when(F.col(entity).isNull(), F.lit(None).cast("double"))
                        .otherwise((F.col("__us") - F.col("__prev")) / F.lit(float(US_PER_S)))) \
            .drop("__prev")
    return out.drop("__us", "__day")


def _running_prev_max(df: DataFrame, entity: str, id_col: str, bucket_us: int) -> DataFrame:
    per_day = df.groupBy(entity, "__day").agg(F.max("__us").alias("__dmax"))
    w = Window.partitionBy(entity).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    prev_day = per_day.select(F.col(entity).alias("__pe"), F.col("__day").alias("__pd"),
                              F.max("__dmax").over(w).alias("__pmax"))
    w_in = Window.partitionBy(entity, "__day").orderBy("__us", id_col)
    inner = df.withColumn("__lag", F.lag("__us").over(w_in))
    j = inner.join(prev_day, F.col(entity).eqNullSafe(F.col("__pe"))
                   & F.col("__day").eqNullSafe(F.col("__pd")), "left")
    return j.withColumn("__prev", F.coalesce(F.col("__lag"), F.col("__pmax"))) \
        .drop("__pe", "__pd", "__pmax", "__lag")


def novelty_flags(df: DataFrame, *, date_col: str = "date", id_col: str = "id",
                  entities=(("card_id", "card"), ("client_id", "user")),
                  attrs: tuple | None = None) -> tuple[DataFrame, dict[str, Column]] | None:
    """(narrow table by ``__fid``, columns) of the flags of ``add_novelty``; None without any pair of columns.

    Plan: one scan explodes each row into its (flag, entity, attribute) keys;
    per key ``min(struct(us, id))`` is a partial aggregation, so a hot pair is
    combined map-side; one left join on the unique row id attaches all flags
    (no skew on a unique key).
    """
    mcc = "mcc_str" if "mcc_str" in df.columns else "mcc"
    attrs = attrs or (("merchant_id", "merchant"), (mcc, "mcc"))
    pairs = []
    names = []
    for entity, eprefix in entities:
        if entity not in df.columns:
            continue
        for attr, aname in attrs:
            if attr not in df.columns:
                continue
            name = f"first_time_{aname}_{eprefix}"
            names.append(name)
            pairs.append(F.when(F.col(entity).isNotNull() & F.col(attr).isNotNull(),
                                F.struct(F.lit(name).alias("f"), F.col(entity).cast("string").alias("e"),
                                         F.col(attr).cast("string").alias("a"))))
    if not names:
        return None
    # one scan: every row becomes up to len(names) (flag, entity, attribute) keys
    keyed = df.select(epoch_us(date_col).alias("__u"), F.col(id_col).alias("__i"),
                      F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("__k"))
    firsts = keyed.groupBy("__k").agg(F.min(F.struct("__u", "__i")).alias("__m")) \
        .select(F.col("__m.__i").alias("__fid"), F.col("__k.f").alias("__flag"))
    flags = firsts.groupBy("__fid").agg(
        *[F.max(F.when(F.col("__flag") == n, 1).otherwise(0)).alias(n) for n in names])
    return flags, {n: F.coalesce(F.col(n), F.lit(0)).cast("int") for n in names}


def add_novelty(df: DataFrame, *, id_col: str = "id", **options) -> DataFrame:
    """``first_time_{attr}_{entity}`` = 1 on the first row (date, id) of
    each (entity, attribute) pair; NULL attribute or entity -> 0.  Options: those
    of ``novelty_flags``."""
    flags = novelty_flags(df, id_col=id_col, **options)
    return attach_features(df, id_col, [flags]) if flags else df


def add_z_score_amount(df: DataFrame, *, date_col: str = "date", amount_col: str = "amount",
                       entity_col: str = "client_id", window: str = "7d", eps: float = Z_EPS,
                       id_col: str = "id", ties: str = "row_order", bucket_factor: int = 1) -> DataFrame:
    """W10 alone: z-score of the amount against the entity's past window."""
    narrow, columns = velocity_features(df, entity_col, "z", date_col=date_col, amount_col=amount_col, id_col=id_col,
                                        merchant_col=None, mcc_col=None, windows={"w": window}, ties=ties,
                                        bucket_factor=bucket_factor, z_window=window, z_eps=eps)
    return attach_features(df, id_col, [(narrow, {"z_score_amount": columns["z_score_amount"]})])


def add_velocity_ratios(df: DataFrame, prefix: str, pairs=(("1h", "24h"), ("24h", "7d"))) -> DataFrame:
    """Count and amount ratios between a short and a long window (NULL on 0)."""
    out = df
    for a, b in pairs:
        out = out.withColumn(f"{prefix}_count_ratio_{a}_{b}",
                             F.try_divide(F.col(f"{prefix}_tx_count_{a}").cast("double"),
                                          F.col(f"{prefix}_tx_count_{b}").cast("double")))
        out = out.withColumn(f"{prefix}_amount_ratio_{a}_{b}",
                             F.try_divide(F.col(f"{prefix}_amount_sum_{a}"),
                                          F.col(f"{prefix}_amount_sum_{b}")))
    return out


def behavioral_parts(df: DataFrame, *, date_col: str = "date", amount_col: str = "amount", windows: dict | None = None,
                     z_window: str = "7d", eps: float = Z_EPS, ties: str = "row_order",
                     bucket_factor: int = 1) -> list[tuple[DataFrame, dict[str, Column]]]:
    """The narrow tables of ``add_behavioral_features``, for ``attach_features``."""
    options = dict(date_col=date_col, amount_col=amount_col, windows=windows, ties=ties, bucket_factor=bucket_factor, recency=True)
    parts = []
    if "card_id" in df.columns:
        parts.append(velocity_features(df, "card_id", "card", **options))
    if "client_id" in df.columns:
        parts.append(velocity_features(df, "client_id", "user", z_window=z_window, z_eps=eps, **options))
    return parts + [p for p in [novelty_flags(df, date_col=date_col)] if p]


def add_behavioral_features(df: DataFrame, **options) -> DataFrame:
    """Card and user velocity, recency, novelty and the user z-score.

    Each entity's features and the novelty flags are narrow tables by id, made
    from the columns they need; all are joined to the wide rows at once.
    Options: those of ``behavioral_parts``.
    """
    return attach_features(df, "id", behavioral_parts(df, **options))
