"""Smoothed past-only fraud rates per merchant / MCC / card brand.

rate_i = (fraud_past + alpha) / (labeled_past + beta), "past" = rows of the
same entity before row i in (date, id) order (``ties="strict"``: date < t).
Only labeled rows count; a cold entity gets alpha / beta; a NULL entity NULL.

All rates of one call come from one narrow table: a row is exploded into its
(kind, entity) keys, running sums go in two levels (totals per key and hour,
then inside the hour), so a low-cardinality key (4 brands, ~100 MCCs) is many
tasks, and the rates are joined to the wide rows by id, once.  The id must be
unique and not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import RATE_ALPHA, RATE_BETA
from riskloom.functions.timecols import US_PER_S, epoch_us
from riskloom.operators.windows import attach_features

US_PER_HOUR = 3600 * US_PER_S


def rate_features(df: DataFrame, rates: dict[str, str], *, date_col: str = "date", id_col: str = "id", label_col: str = "is_fraud",
                  has_label_col: str = "has_label", alpha: float = RATE_ALPHA, beta: float = RATE_BETA, ties: str = "row_order",
                  bucket_us: int = US_PER_HOUR) -> tuple[DataFrame, dict[str, Column]]:
    """(narrow table by ``__fid``, columns) of the rates ``{out column: entity column}``."""
    labeled = F.coalesce(F.col(has_label_col).cast("boolean"), F.lit(False)) if has_label_col in df.columns else F.lit(True)
    kinds = list(rates)
    keys = [F.when(F.col(rates[o]).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(rates[o]).cast("string").alias("key")))
            for i, o in enumerate(kinds)]
    us = epoch_us(date_col)
    rows = df.where(us.isNotNull()).select(
        F.col(id_col).alias("id"), us.alias("us"), F.floor(us / F.lit(bucket_us)).cast("long").alias("b"),
        F.when(labeled, 1).otherwise(0).cast("long").alias("lab"),
        F.when(labeled, F.coalesce(F.col(label_col), F.lit(0))).otherwise(0).cast("double").alias("fraud"),
        F.explode(F.array_compact(F.array(*keys))).alias("k")).select("id", "us", "b", "lab", "fraud", "k.kind", "k.key")
    group = ["kind", "key", "b"]
    earlier = Window.partitionBy("kind", "key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*group).agg(F.sum("lab").alias("lab"), F.sum("fraud").alias("fraud")) \
        .select(*group, F.sum("lab").over(earlier).alias("lab0"), F.sum("fraud").over(earlier).alias("fraud0"))
    inside = Window.partitionBy(*group)
    past = inside.orderBy("us").rangeBetween(Window.unboundedPreceding, -1) if ties == "strict" \
        else inside.orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.select("id", *group, F.sum("lab").over(past).alias("lab1"), F.sum("fraud").over(past).alias("fraud1")).join(before, group)

    def total(name: str) -> Column:
        return F.coalesce(f"{name}0", F.lit(0)) + F.coalesce(f"{name}1", F.lit(0))

    rate = (total("fraud") + F.lit(alpha)) / (total("lab") + F.lit(beta))
    narrow = sums.select("id", "kind", rate.cast("double").alias("rate")).groupBy(F.col("id").alias("__fid")) \
        .agg(*[F.max(F.when(F.col("kind") == i, F.col("rate"))).alias(f"__rate_{o}") for i, o in enumerate(kinds)])
    return narrow, {o: F.col(f"__rate_{o}") for o in kinds}


def add_entity_fraud_rate(df: DataFrame, entity_col: str, out_col: str, **kw) -> DataFrame:
    """The rate of one entity column; no-op when it is absent.  Options: those of ``rate_features``."""
    if entity_col not in df.columns:
        return df
    return attach_features(df, kw.get("id_col", "id"), [rate_features(df, {out_col: entity_col}, **kw)])


def add_merchant_fraud_rate(df: DataFrame, **kw) -> DataFrame:
    """W12."""
    return add_entity_fraud_rate(df, kw.pop("entity_col", "merchant_id"),
                                 kw.pop("out_col", "merchant_historical_fraud_rate"), **kw)


def add_mcc_fraud_rate(df: DataFrame, **kw) -> DataFrame:
    """Per MCC; falls back from mcc_str to mcc."""
    col = kw.pop("mcc_col", "mcc_str")
    if col not in df.columns:
        col = "mcc"
    return add_entity_fraud_rate(df, col, kw.pop("out_col", "mcc_historical_fraud_rate"), **kw)


def add_card_brand_fraud_rate(df: DataFrame, **kw) -> DataFrame:
    """Per card brand; no-op when the column is absent."""
    return add_entity_fraud_rate(df, kw.pop("entity_col", "card_brand"),
                                 kw.pop("out_col", "card_brand_historical_fraud_rate"), **kw)


def risk_rates(df: DataFrame, include_card_brand: bool = True) -> dict[str, str]:
    """Rate columns of W15 and their entity columns, as far as ``df`` has them."""
    wanted = {"merchant_historical_fraud_rate": "merchant_id",
              "mcc_historical_fraud_rate": "mcc_str" if "mcc_str" in df.columns else "mcc"}
    if include_card_brand:
        wanted["card_brand_historical_fraud_rate"] = "card_brand"
    return {o: c for o, c in wanted.items() if c in df.columns}


def add_risk_aggregates(df: DataFrame, *, include_card_brand: bool = True, **kw) -> DataFrame:
    """Merchant, MCC and (optionally) card-brand rates, in one pass."""
    rates = risk_rates(df, include_card_brand)
    return attach_features(df, kw.get("id_col", "id"), [rate_features(df, rates, **kw)]) if rates else df
