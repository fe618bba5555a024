from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators import gold


def _col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"s {typ}")


def test_parse_currency(spark):
    df = _col(spark, ["$100.00", "$-50.50", " $1,234.56 ", "$0.00", "abc", None])
    got = [r[0] for r in df.select(S.parse_currency("s")).collect()]
    assert got == [100.0, -50.5, 1234.56, 0.0, None, None]


def test_parse_card_bools(spark):
    df = spark.createDataFrame([("YES", "TRUE"), ("NO", "FALSE"), (" y ", None)], "has_chip string, card_on_dark_web string")
    out = gold.prepare_cards(df).collect()
    assert [r.has_chip for r in out] == [1, 0, 1]
    assert [r.card_on_dark_web for r in out] == [1, 0, 0]


def test_time_features(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 3),), (datetime(2020, 1, 1, 12),),
                                (datetime(2020, 1, 4),), (datetime(2020, 1, 6),), (None,)], "date timestamp")
    out = gold.add_time_features(df).collect()
    assert [r.is_night for r in out] == [1, 0, 1, 1, 0]
    assert [r.is_weekend for r in out] == [0, 0, 1, 0, 0]
    assert out[2].day_of_week == 5 and out[3].day_of_week == 0


def test_prepare_cards(spark):
    df = spark.createDataFrame([("$5,000.00", "YES", "01/2015"), ("$10,000.00", "NO", "06/2020"),
                                ("$-100.00", "NO", "13/2020"), ("junk", "NO", "xx")],
                               "credit_limit string, has_chip string, acct_open_date string")
    out = gold.prepare_cards(df).collect()
    assert [r.credit_limit for r in out] == [5000.0, 10000.0, None, None]
    assert out[0].acct_open_date == datetime(2015, 1, 1)
    assert out[2].acct_open_date is None and out[3].acct_open_date is None


def test_negative_limits_and_incomes(spark):
    c = spark.createDataFrame([(-100.0,), (5000.0,)], "credit_limit double")
    assert [r[0] for r in gold.prepare_cards(c).collect()] == [None, 5000.0]
    u = spark.createDataFrame([(-1000.0,), (50000.0,)], "yearly_income double")
    assert [r[0] for r in gold.prepare_users(u).collect()] == [None, 50000.0]


def test_prepare_users(spark):
    u = spark.createDataFrame([("$40,000", "$80,000", "$1,000")], "per_capita_income string, yearly_income string, total_debt string")
    r = gold.prepare_users(u).first()
    assert r.yearly_income == 80000.0 and r.per_capita_income == 40000.0


def test_acct_age_days(spark):
    df = spark.createDataFrame([(datetime(2020, 6, 15), datetime(2020, 1, 1)), (datetime(2020, 6, 15), None),
                                (datetime(2019, 6, 15), datetime(2020, 1, 1))], "date timestamp, acct_open_date timestamp")
    got = [r.acct_age_days for r in gold.add_acct_age_days(df).collect()]
    assert got == [166, None, 0]


def test_gold_join_row_count_and_suffixes(spark):
    tx = spark.createDataFrame([(1, datetime(2020, 1, 1), 10, 100, "$5.00", "5411"),
                                (2, datetime(2020, 1, 2), 11, 100, "$7.00", "9999")],
                               "id long, date timestamp, card_id long, client_id long, amount string, mcc string")
    cards = spark.createDataFrame([(10, 100, "Visa", "$1,000", "01/2019", "YES")],
                                  "id long, client_id long, card_brand string, credit_limit string, acct_open_date string, has_chip string")
    users = spark.createDataFrame([(100, 40, "$10,000")], "id long, current_age int, yearly_income string")
    mcc = spark.createDataFrame([("5411", "Grocery")], "mcc_str string, mcc_description string")
    labels = spark.createDataFrame([(1, 1)], "transaction_id long, is_fraud int")
    g = gold.build_gold_table(tx, cards, users, mcc, labels, validate=True)
    rows = {r.id: r for r in g.collect()}
    assert len(rows) == 2
    assert "id_card" in g.columns and "client_id_card" in g.columns and "id_user" in g.columns
    assert rows[1].has_label and rows[1].is_fraud == 1 and not rows[2].has_label
    assert rows[1].mcc_description == "Grocery" and rows[2].mcc_description is None
    assert rows[1].acct_age_days == 365 and rows[2].acct_age_days is None


def test_duplicate_label_ids_fail_before_they_multiply_rows(spark):
    tx = spark.createDataFrame([(1,), (2,)], "id long")
    twice = spark.createDataFrame([(1, 1), (1, 0)], "transaction_id long, is_fraud int")
    with pytest.raises(ValueError, match="duplicate transaction_id"):
        gold.attach_labels(tx, twice)
    assert gold.attach_labels(tx, twice, validate=False).count() == 3


def test_duplicate_dimension_key_fails(spark):
    d = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(ValueError):
        gold.assert_unique_key(d, "id")


def test_display_value(spark):
    df = spark.createDataFrame([(-999.0, "x" * 50)], "a double, b string")
    r = df.select(S.display_value("a").alias("a"), S.display_value("b").alias("b")).first()
    assert r.a == "(missing)" and r.b == "x" * 40 + "..."


def test_clip(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double")
    got = [r[0] for r in df.select(S.clip_prob("p")).collect()]
    assert got == [1e-6, 1 - 1e-6, 0.5]
    assert F is not None
