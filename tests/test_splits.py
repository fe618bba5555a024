from datetime import datetime

from pyspark.sql import functions as F

from riskloom.config import SplitBoundaries
from riskloom.operators import splits

B = SplitBoundaries(train_end="2017-12-31", val_end="2019-12-31", test_start="2020-01-01")


def _split_df(spark):
    dates = [datetime(2016, 6, 1), datetime(2017, 6, 1), datetime(2017, 12, 31), datetime(2018, 6, 1),
             datetime(2019, 6, 1), datetime(2020, 6, 1), datetime(2021, 6, 1)]
    fraud = [0, 0, 1, 0, 1, 0, 0]
    return spark.createDataFrame([(i, d, i, f, True) for i, (d, f) in enumerate(zip(dates, fraud))],
                                 "id long, date timestamp, amount int, is_fraud int, has_label boolean")


def test_split_sizes_and_rates(spark):
    df = splits.add_split(_split_df(spark), B)
    r = {x.split: x for x in splits.split_fraud_rates(df).collect()}
    assert (r["train"].rows, r["val"].rows, r["test"].rows) == (3, 2, 2)
    assert (r["train"].fraud_count, r["val"].fraud_count, r["test"].fraud_count) == (1, 1, 0)
    assert r["test"].fraud_rate == 0.0


def test_split_disjoint_and_three_frames(spark):
    tr, va, te = splits.time_based_splits(_split_df(spark), B)
    ids = [set(r.id for r in d.collect()) for d in (tr, va, te)]
    assert not (ids[0] & ids[1]) and not (ids[1] & ids[2]) and not (ids[0] & ids[2])
    assert tr.intersect(va).count() == 0


def test_empty_val(spark):
    df = spark.createDataFrame([(1, datetime(2015, 1, 1), 0, True), (2, datetime(2022, 1, 1), 0, True)],
                               "id long, date timestamp, is_fraud int, has_label boolean")
    r = {x.split: x for x in splits.split_fraud_rates(splits.add_split(df, B)).collect()}
    assert r["val"].rows == 0 and r["val"].fraud_rate == 0.0


def test_midnight_boundary(spark):
    df = spark.createDataFrame([(1, datetime(2017, 12, 31, 12), 0, True)], "id long, date timestamp, is_fraud int, has_label boolean")
    assert splits.add_split(df, B).first().split == "val"
    eod = SplitBoundaries("2017-12-31", "2019-12-31", "2020-01-01", end_of_day=True)
    assert splits.add_split(df, eod).first().split == "train"


def test_hash_top_n_equals_order_limit(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = sorted(r.k for r in splits.hash_top_n(df, 777, "k").collect())
    exp = sorted(r.k for r in df.orderBy(splits.hash_key("k"), "k").limit(777).collect())
    assert got == exp


def test_stratified_keeps_all_positives(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 50 == 0).cast("int").alias("is_fraud"))
    out = splits.stratified_sample(df, 300)
    assert out.count() == 300 and out.where("is_fraud = 1").count() == 20
