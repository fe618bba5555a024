"""Declared raw schemas (no inference; types fixed at plan time)."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


TRANSACTIONS_SCHEMA = _s(
    ("id", LongType()), ("date", StringType()), ("client_id", LongType()), ("card_id", LongType()),
    ("amount", StringType()), ("use_chip", StringType()), ("merchant_id", LongType()),
    ("merchant_city", StringType()), ("merchant_state", StringType()), ("zip", DoubleType()),
    ("mcc", StringType()), ("errors", StringType()))

CARDS_SCHEMA = _s(
    ("id", LongType()), ("client_id", LongType()), ("card_brand", StringType()), ("card_type", StringType()),
    ("card_number", StringType()), ("expires", StringType()), ("cvv", IntegerType()), ("has_chip", StringType()),
    ("num_cards_issued", IntegerType()), ("credit_limit", StringType()), ("acct_open_date", StringType()),
    ("year_pin_last_changed", IntegerType()), ("card_on_dark_web", StringType()))

USERS_SCHEMA = _s(
    ("id", LongType()), ("current_age", IntegerType()), ("retirement_age", IntegerType()),
    ("birth_year", IntegerType()), ("birth_month", IntegerType()), ("gender", StringType()),
    ("address", StringType()), ("latitude", DoubleType()), ("longitude", DoubleType()),
    ("per_capita_income", StringType()), ("yearly_income", StringType()), ("total_debt", StringType()),
    ("credit_score", IntegerType()), ("num_credit_cards", IntegerType()))
