"""Registered queries: (spark, sf_dir) -> DataFrame over the driver tables.

Each query reads whole tables (or views Spark derives from them); the final
``rounded`` projection only fixes float presentation for the oracle compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import risk as RK
from riskloom.operators import windows as W
from riskloom.plans import views as V

from riskloom.plans.queries_common import R, rounded  # noqa: F401


def _new_cols(out: DataFrame, src: DataFrame) -> list[str]:
    return [c for c in out.columns if c not in set(src.columns)]


# -- windows ----------------------------------------------------------------

def q_velocity_user(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    out = W.add_velocity(t, "client_id", "user")
    return rounded(out.select("id", *_new_cols(out, t)))


def q_velocity_card(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    out = W.add_velocity(t, "card_id", "card")
    return rounded(out.select("id", *_new_cols(out, t)))


def _orders_tx(spark: SparkSession, sf: str) -> DataFrame:
    fo = V.fact_orders(spark, sf)
    return fo.select("id", "date", "client_id", "amount",
                     F.lit(None).cast("bigint").alias("merchant_id"), F.col("segment").alias("mcc_str"))


ORDER_WINDOWS = {"7d": 604800, "90d": 7776000}


def q_velocity_orders_ties(spark: SparkSession, sf: str) -> DataFrame:
    t = _orders_tx(spark, sf)
    out = W.add_velocity(t, "client_id", "cust", windows=ORDER_WINDOWS)
    return rounded(out.select("id", *_new_cols(out, t)))


def q_velocity_orders_strict(spark: SparkSession, sf: str) -> DataFrame:
    t = _orders_tx(spark, sf)
    out = W.add_velocity(t, "client_id", "cust", windows=ORDER_WINDOWS, ties="strict")
    return rounded(out.select("id", *_new_cols(out, t)))


def _velocity_part(kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        t = V.tx(spark, sf)
        out = W.add_velocity(t, "client_id", "user")
        cols = [c for c in _new_cols(out, t) if c.startswith(f"user_{kind}_")]
        return rounded(out.select("id", *cols))
    return q


def q_recency(spark: SparkSession, sf: str) -> DataFrame:
    out = W.add_time_since_last_tx(V.tx(spark, sf))
    return rounded(out.select("id", "time_since_last_tx_card", "time_since_last_tx_user"))


def q_recency_orders(spark: SparkSession, sf: str) -> DataFrame:
    out = W.add_time_since_last_tx(_orders_tx(spark, sf), entities=(("client_id", "cust"),))
    return rounded(out.select("id", "time_since_last_tx_cust"))


def q_novelty(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    out = W.add_novelty(t)
    return out.select("id", *_new_cols(out, t))


def q_z_score(spark: SparkSession, sf: str) -> DataFrame:
    out = W.add_z_score_amount(V.tx(spark, sf))
    return rounded(out.select("id", "z_score_amount"), overrides={"z_score_amount": 4})


def q_behavioral_all(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    out = W.add_behavioral_features(t)
    return rounded(out.select("id", *_new_cols(out, t)), overrides={"z_score_amount": 4})


def q_velocity_ratio(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    out = W.add_velocity_ratios(W.add_velocity(t, "client_id", "user"), "user")
    return rounded(out.select("id", *[c for c in out.columns if "_ratio_" in c]))


def _rate_query(fn, col: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(fn(V.tx(spark, sf)).select("id", col))
    return q


def q_risk_rates_all(spark: SparkSession, sf: str) -> DataFrame:
    out = RK.add_risk_aggregates(V.tx(spark, sf))
    return rounded(out.select("id", "merchant_historical_fraud_rate", "mcc_historical_fraud_rate",
                              "card_brand_historical_fraud_rate"))


def q_risk_rate_orders_strict(spark: SparkSession, sf: str) -> DataFrame:
    fo = V.fact_orders(spark, sf).withColumn("has_label", F.col("status") != "P") \
        .withColumn("is_fraud", F.when(F.col("status") != "P", (F.col("priority") == "1-URGENT").cast("int")))
    out = RK.add_entity_fraud_rate(fo, "segment", "segment_rate", ties="strict")
    out = RK.add_entity_fraud_rate(out, "nation", "nation_rate")
    return rounded(out.select("id", "segment_rate", "nation_rate"))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from riskloom.plans import q_data, q_eval, q_ml
    return {**WINDOW_QUERIES, **q_data.QUERIES, **q_eval.QUERIES, **q_ml.QUERIES}


WINDOW_QUERIES = {
        "velocity_user": q_velocity_user,
        "velocity_card": q_velocity_card,
        "velocity_orders_ties": q_velocity_orders_ties,
        "velocity_orders_strict": q_velocity_orders_strict,
        "velocity_count": _velocity_part("tx_count"),
        "velocity_sum": _velocity_part("amount_sum"),
        "velocity_mean": _velocity_part("amount_mean"),
        "velocity_max": _velocity_part("amount_max"),
        "velocity_unique_merchants": _velocity_part("unique_merchants"),
        "velocity_unique_mcc": _velocity_part("unique_mcc"),
        "recency": q_recency,
        "recency_orders": q_recency_orders,
        "novelty": q_novelty,
        "z_score": q_z_score,
        "behavioral_all": q_behavioral_all,
        "velocity_ratio": q_velocity_ratio,
        "risk_rate_merchant": _rate_query(RK.add_merchant_fraud_rate, "merchant_historical_fraud_rate"),
        "risk_rate_mcc": _rate_query(RK.add_mcc_fraud_rate, "mcc_historical_fraud_rate"),
        "risk_rate_brand": _rate_query(RK.add_card_brand_fraud_rate, "card_brand_historical_fraud_rate"),
        "risk_rates_all": q_risk_rates_all,
        "risk_rate_orders_strict": q_risk_rate_orders_strict,
}
