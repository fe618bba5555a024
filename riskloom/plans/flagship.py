"""Flagship plan: transactions -> past-only behaviour + smoothed risk rates
-> alert level.  One lazy Catalyst plan over the whole events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import risk, windows
from riskloom.operators.score import risk_level
from riskloom.plans import views as V


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tx(spark, sf_dir)
    feats = windows.attach_features(t, "id", windows.behavioral_parts(t) + [risk.rate_features(t, risk.risk_rates(t))])
    scored = risk_level(feats, "p")
    return scored.select(
        "id", "date", "card_id", "client_id", "amount", "risk_score", "level", "action",
        "card_tx_count_1h", "card_amount_sum_24h", "user_tx_count_24h", "user_unique_merchants_7d",
        "z_score_amount", "time_since_last_tx_card", "first_time_merchant_card",
        "merchant_historical_fraud_rate", "mcc_historical_fraud_rate", "card_brand_historical_fraud_rate",
    ).where(F.col("id").isNotNull())
