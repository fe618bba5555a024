"""Model-matrix preparation and target encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from riskloom.config import CAT_MISSING, EXCLUDE_FEATURES, EXTRA_EXCLUDE, NUM_MISSING, TE_SMOOTHING
from riskloom.functions.scalar import fill_cat, fill_num
from riskloom.operators.gold import broadcast_if_small
from riskloom.operators.splits import hash_key


def get_feature_columns(df: DataFrame, target_col: str = "is_fraud", exclude: set[str] | None = None,
                        exclude_ids: bool = True) -> tuple[list[str], list[str]]:
    """(features, categorical) from the schema at plan time.  String and
    boolean columns are categorical, numeric ones numeric, others dropped."""
    ex = set(exclude if exclude is not None else EXCLUDE_FEATURES) | {target_col}
    if exclude_ids:
        ex |= set(EXTRA_EXCLUDE)
    feats, cats = [], []
    for f in df.schema.fields:
        if f.name in ex:
            continue
        if isinstance(f.dataType, (StringType, BooleanType)):
            feats.append(f.name)
            cats.append(f.name)
        elif isinstance(f.dataType, NumericType):
            feats.append(f.name)
    return feats, cats


def prepare_matrix(df: DataFrame, features: list[str], cats: list[str], keep: list[str] | None = None) -> DataFrame:
    """Categorical -> string with '__missing__', numeric -> double with -999;
    absent feature columns appear as their fill value (reindex semantics)."""
    cols = [F.col(c) for c in (keep or []) if c in df.columns]
    for c in features:
        if c in cats:
            cols.append((fill_cat(c) if c in df.columns else F.lit(CAT_MISSING)).alias(c))
        else:
            cols.append((fill_num(c) if c in df.columns else F.lit(NUM_MISSING)).alias(c))
    return df.select(*cols)


def payload_to_features(df: DataFrame, payload_col: str, fields: dict[str, str]) -> DataFrame:
    """JSON payload -> typed feature columns; a missing key or an
    unparsable value becomes -999 for numeric fields, '__missing__' otherwise."""
    out = df
    for name, typ in fields.items():
        raw = F.get_json_object(F.col(payload_col), f"$.{name}")
        if typ in ("string", "category"):
            out = out.withColumn(name, fill_cat(raw))
        else:
            out = out.withColumn(name, F.coalesce(raw.try_cast(typ), F.lit(NUM_MISSING).cast(typ)))
    return out


def parse_payload(df: DataFrame, payload_col: str, fields: dict[str, str], error: str = "error") -> DataFrame:
    """F11 for scoring: one permissive parse of a JSON payload into ``fields``
    (name -> type) and ``error``: NULL, or why the row cannot be scored (no
    payload, not JSON, a value that is not of its type).  An absent key is no
    error; its field is NULL.  Rows are never lost."""
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", `__bad` string"
    parsed = F.from_json(F.col(payload_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = df.withColumn("__p", parsed)
    why = F.when(F.col(payload_col).isNull() | (F.trim(payload_col) == ""), "missing payload") \
        .when(F.col("__p").isNull() | F.col("__p.__bad").isNotNull(), "malformed payload")
    return out.select(*[c for c in df.columns if c not in fields and c != error],
                      *[F.col(f"__p.{n}").alias(n) for n in fields], why.alias(error))


def target_encode_fit(df: DataFrame, cats: list[str], target: str = "y",
                      smoothing: float = TE_SMOOTHING) -> DataFrame:
    """A2: (feature, category, encoding, global_mean) with
    encoding = (n * mean + m * global) / (n + m); '__missing__' is a category.
    One pass per column, map-side combined; the global mean is an equi-joined
    one-row aggregate."""
    keyed = df.withColumn("__k", F.lit(0))
    gm = keyed.groupBy("__k").agg(F.avg(F.col(target).cast("double")).alias("global_mean"))
    parts = []
    for c in cats:
        g = keyed.groupBy("__k", fill_cat(c).alias("category")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("mean"))
        parts.append(g.withColumn("feature", F.lit(c)))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    j = allp.join(gm, "__k")
    enc = (F.col("n") * F.col("mean") + F.lit(smoothing) * F.col("global_mean")) / (F.col("n") + F.lit(smoothing))
    return j.select("feature", "category", enc.alias("encoding"), "global_mean", "n")


def target_encode_apply(df: DataFrame, encoders: DataFrame, cats: list[str], suffix: str = "") -> DataFrame:
    """Replace each categorical by its encoding; unseen -> global mean (one
    bounded lookup for all features).  Each per-feature lookup table is joined
    with a checked-size broadcast."""
    means = {r["feature"]: r["m"] for r in encoders.where(F.col("feature").isin(cats)).groupBy("feature")
             .agg(F.first("global_mean").alias("m")).collect()}
    out = df
    for c in cats:
        e = encoders.where(F.col("feature") == c).select(
            F.col("category").alias(f"__cat_{c}"), F.col("encoding").alias(f"__enc_{c}"))
        out = out.withColumn(f"__key_{c}", fill_cat(c))
        out = out.join(broadcast_if_small(e), F.col(f"__key_{c}") == F.col(f"__cat_{c}"), "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col(f"__enc_{c}"), F.lit(means.get(c)).cast("double")))
        out = out.drop(f"__cat_{c}", f"__enc_{c}", f"__key_{c}")
    return out


def fold_of(id_col: str, folds: int, seed: int = 42) -> Column:
    """Fold 0 .. folds - 1 of a row, from a hash of its id (0 for a NULL id)."""
    h = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(h, F.lit(folds)).cast("int"), F.lit(0))


def target_encode_oof(df: DataFrame, cats: list[str], target: str = "y", id_col: str = "id", folds: int = 5,
                      smoothing: float = TE_SMOOTHING, suffix: str = "_te", seed: int = 42) -> DataFrame:
    """Target encoding of training rows out of fold: a row's category is encoded
    from the rows of the other folds, so no row sees its own label.

    Sums by (feature, category, fold) in one grouped pass over all categoricals;
    what the other folds hold is the total minus the own fold.  A category that
    the other folds do not have gets their global mean (NULL if they are empty).
    Rows with a NULL target are encoded but add nothing.
    """
    rows = df.withColumn("__fold", fold_of(id_col, folds, seed))
    y = F.col(target).cast("double")
    cells = F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("category")),
                    *[F.struct(F.lit(c).alias("feature"), fill_cat(c).alias("category")) for c in cats])
    sums = rows.select("__fold", y.alias("y"), F.explode(cells).alias("c")).groupBy("c.feature", "c.category", "__fold") \
        .agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    own = Window.partitionBy("feature", "category")               # one row for each fold
    others = sums.select("feature", "category", "__fold", (F.sum("n").over(own) - F.col("n")).alias("n"),
                         (F.sum("s").over(own) - F.col("s")).alias("s"))
    prior = others.where("feature is null").select("__fold", F.try_divide(F.col("s"), F.col("n").cast("double")).alias("__prior"))
    out = rows.join(F.broadcast(prior), "__fold")                 # one row for each fold
    for c in cats:
        enc = others.where(F.col("feature") == c).select(
            F.col("category").alias("__cat"), F.col("__fold").alias("__of"), F.col("n").alias("__n"), F.col("s").alias("__s"))
        out = out.withColumn("__key", fill_cat(c)) \
            .join(broadcast_if_small(enc), (F.col("__key") == F.col("__cat")) & (F.col("__fold") == F.col("__of")), "left") \
            .withColumn(c + suffix, (F.col("__s") + F.lit(float(smoothing)) * F.col("__prior")) / (F.col("__n") + F.lit(float(smoothing)))) \
            .drop("__key", "__cat", "__of", "__n", "__s")
    return out.drop("__fold", "__prior")


def class_weights(df: DataFrame, label: str = "y", scale_pos_weight: float = 1.0) -> DataFrame:
    """L4: weight column = scale_pos_weight for positives, 1 otherwise."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0)))
