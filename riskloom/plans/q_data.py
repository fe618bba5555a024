"""Registered queries: scans, static parsing, gold join, splits, sampling, profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import ACTIONS, SplitBoundaries
from riskloom.functions import scalar as S
from riskloom.operators import eda, gold, splits
from riskloom.operators.score import risk_level
from riskloom.plans import views as V
from riskloom.plans.queries_common import rounded
from riskloom.session import checkpoint_dir
from riskloom.sources import sinks

TX_SPLITS = SplitBoundaries(train_end="2024-01-20", val_end="2024-01-25", test_start="2024-01-26")
DRIFT_CUT = "2024-01-16"


def q_scan_tx(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.tx(spark, sf))


def q_labeled_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    return rounded(t.where(F.col("has_label")).dropna(subset=["is_fraud"]).select("id", "is_fraud", "amount"))


def q_static_tx(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf).select("id", "date", F.col("amount_raw").alias("amount"))
    out = gold.prepare_static_transaction(t)
    return rounded(out.drop("date"))


def _currency_variants(t: DataFrame) -> DataFrame:
    """Formatting variants of the same amounts: padded, negative, thousands
    separators, and junk that must parse to NULL."""
    v = F.col("amount")
    raw = (F.when(F.col("mcc_str") == "view", F.concat(F.lit(" "), F.col("amount_raw"), F.lit(" ")))
           .when(F.col("mcc_str") == "click", F.regexp_replace("amount_raw", r"^\$", "\\$-"))
           .when(F.col("mcc_str") == "purchase", F.concat(F.lit("$"), F.format_number(v * 1000, 2)))
           .when(F.col("mcc_str") == "error", F.concat(F.lit("n/a"), F.col("amount_raw")))
           .otherwise(F.col("amount_raw")))
    return t.select("id", raw.alias("raw"))


def q_parse_currency(spark: SparkSession, sf: str) -> DataFrame:
    c = _currency_variants(V.tx(spark, sf))
    return rounded(c.select("id", "raw", S.parse_currency("raw").alias("parsed")))


def _cards_raw(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read_table(spark, sf, "customer")
    flag = (F.when(F.col("c_mktsegment") == "BUILDING", "YES").when(F.col("c_mktsegment") == "AUTOMOBILE", " true ")
            .when(F.col("c_mktsegment") == "MACHINERY", "Y").when(F.col("c_mktsegment") == "HOUSEHOLD", "no")
            .otherwise("0"))
    money = F.concat(F.when(F.col("c_acctbal") < 0, "$-").otherwise("$"), F.format_number(F.abs("c_acctbal"), 2))
    opened = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("/1995"))
    return c.select(F.col("c_custkey").alias("id"), money.alias("credit_limit"), opened.alias("acct_open_date"),
                    flag.alias("has_chip"))


def q_parse_bool(spark: SparkSession, sf: str) -> DataFrame:
    c = _cards_raw(spark, sf)
    return c.select("id", "has_chip", S.parse_bool_flag("has_chip").alias("flag"))


def q_parse_month_year(spark: SparkSession, sf: str) -> DataFrame:
    o = V.read_table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("13/"), F.year("o_orderdate").cast("string"))) \
        .otherwise(F.date_format("o_orderdate", "MM/yyyy"))
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"), S.parse_month_year(raw).alias("parsed"))


def q_acct_age(spark: SparkSession, sf: str) -> DataFrame:
    fo = V.fact_orders(spark, sf)
    c = _cards_raw(spark, sf).select(F.col("id").alias("cid"), S.parse_month_year("acct_open_date").alias("opened"))
    j = fo.join(gold.broadcast_if_small(c), fo["client_id"] == c["cid"], "left")
    return j.select("id", S.acct_age_days("date", "opened").alias("acct_age_days"))


def q_time_features(spark: SparkSession, sf: str) -> DataFrame:
    out = gold.add_time_features(V.tx(spark, sf).select("id", "date"))
    return out.drop("date")


def q_parse_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    lab = V.read_table(spark, sf, "labels")
    q = F.when(F.col("quality") == 1, " Yes").otherwise("no ")
    t = F.when(F.col("toxic") == 1, "YES ").otherwise("No")
    return lab.select("doc_id", S.parse_yes_no(q).alias("quality_flag"), S.parse_yes_no(t).alias("toxic_flag"))


def q_static_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gold.prepare_cards(_cards_raw(spark, sf)))


def _users_raw(spark: SparkSession, sf: str) -> DataFrame:
    s = V.read_table(spark, sf, "supplier")

    def money(x):
        return F.concat(F.when(x < 0, "$-").otherwise("$"), F.format_number(F.abs(x), 2))
    u = s.select(F.col("s_suppkey").alias("id"), money(F.col("s_acctbal")).alias("yearly_income"),
                 money(F.col("s_acctbal") / 10).alias("per_capita_income"),
                 money(F.col("s_acctbal") - 5000).alias("total_debt"))
    return u


def q_static_users(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gold.prepare_users(_users_raw(spark, sf)))


def _raw_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as raw transactions (card = customer, client = a supplier, mcc = a nation or none) and their labels."""
    o = V.read_table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("card_id"),
                 (F.col("o_orderkey") % 120 + 1).alias("client_id"),
                 F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(14,2)").cast("string")).alias("amount"),
                 (F.col("o_orderkey") % 27).alias("mcc"))
    lab = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("transaction_id"),
                                                 (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_fraud"))
    return t, lab


def q_gold_table(spark: SparkSession, sf: str) -> DataFrame:
    """J5 on raw tables: parsing, time features, cards, users, merchant categories, labels; keys checked."""
    t, lab = _raw_orders(spark, sf)
    mcc = V.read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("mcc_str"), F.col("n_name").alias("mcc_description"))
    g = gold.build_gold_table(t, _cards_raw(spark, sf), _users_raw(spark, sf), mcc, lab)
    return rounded(g.select("id", "card_id", "client_id", "amount", "hour_of_day", "day_of_week", "is_weekend", "month", "is_night", "credit_limit",
                            "has_chip", "acct_age_days", "yearly_income", "per_capita_income", "total_debt", "mcc_str", "mcc_description",
                            "is_fraud", "transaction_id_str", "has_label"))


def q_label_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with and without labels."""
    t, lab = _raw_orders(spark, sf)
    return gold.attach_labels(t.select("id", "card_id"), lab)


def q_gold_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.fact_orders(spark, sf))


def q_label_join(spark: SparkSession, sf: str) -> DataFrame:
    return gold.label_coverage_join(V.read_table(spark, sf, "documents"), V.read_table(spark, sf, "labels"))


def q_ref_integrity(spark: SparkSession, sf: str) -> DataFrame:
    o = V.read_table(spark, sf, "orders")
    c = V.read_table(spark, sf, "customer")
    n = V.read_table(spark, sf, "nation")
    a = gold.referential_integrity(o, c, "o_custkey", "c_custkey").withColumn("check", F.lit("orders->customer"))
    b = gold.referential_integrity(c, n, "c_nationkey", "n_nationkey").withColumn("check", F.lit("customer->nation"))
    return a.unionByName(b)


def q_time_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.add_split(V.tx(spark, sf), TX_SPLITS).select("id", "split")


def q_split_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(splits.split_fraud_rates(splits.add_split(V.tx(spark, sf), TX_SPLITS)))


def q_sample_entities(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_entities(V.tx(spark, sf), "card_id", 50).select("id", "card_id")


def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    lab = V.tx(spark, sf).where(F.col("has_label"))
    return splits.stratified_sample(lab, 2000).select("id", "is_fraud")


def q_risk_level(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    return rounded(risk_level(t, "p").select("id", "risk_score", "level", "action"))


def q_feature_fill(spark: SparkSession, sf: str) -> DataFrame:
    j = q_label_join(spark, sf)
    return j.select("doc_id", S.fill_cat("lang").alias("lang"), S.fill_cat("source").alias("source"),
                    S.fill_num("quality").alias("quality"), S.fill_num("toxic").alias("toxic"),
                    S.fill_num("n_chars").alias("n_chars"))


def q_prepare_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Filled features of the label join; columns that are absent appear as their fill values."""
    from riskloom.operators.features import prepare_matrix
    return prepare_matrix(q_label_join(spark, sf), ["lang", "source", "quality", "n_chars", "absent_number", "absent_text"],
                          ["lang", "source", "absent_text"], keep=["doc_id"])


def q_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_rows(V.tx(spark, sf), 100).select("id")


def q_sample_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_by_label(V.tx(spark, sf), 1).select("id", "is_fraud")


def q_splits_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The splits as they are read back from where they were saved."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    return spark.read.parquet(splits.save_splits(V.tx(spark, sf).select("id", "date"), path, TX_SPLITS)).select("id", "split")


def q_gold_published(spark: SparkSession, sf: str) -> DataFrame:
    """A table written in date order and published, then published again; readers get the last version."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/gold-{uuid.uuid4().hex}"
    t = V.tx(spark, sf).select("id", "date", "amount", "has_label")
    sinks.write_gold(t, f"{root}/sorted")
    sinks.publish(t.where("has_label"), f"{root}/table")
    sinks.publish(sinks.read_gold(spark, f"{root}/sorted"), f"{root}/table", expected_rows=t.count())
    return rounded(sinks.read_published(spark, f"{root}/table"))


def q_payload_to_features(spark: SparkSession, sf: str) -> DataFrame:
    from riskloom.operators.features import payload_to_features
    e = V.read_table(spark, sf, "events")
    out = payload_to_features(e, "props", {"k": "double", "z": "double"})
    return out.select(F.col("event_id").alias("id"), "k", "z")


# -- profiling --------------------------------------------------------------

def q_missing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.missing_rate(q_label_join(spark, sf), ["quality", "toxic", "lang", "n_chars"]))


def q_numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.numeric_summary(V.tx(spark, sf), ["amount", "p", "merchant_id"]))


def q_categorical_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.categorical_summary(V.tx(spark, sf), ["mcc_str", "card_brand", "merchant_id"], top_n=15))


def q_schema_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.schema_audit(V.fact_orders(spark, sf)))


def q_dq_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tx(spark, sf)
    return rounded(eda.data_quality_checks(t, "id", "date", "amount_raw", as_of="2024-01-29"))


def q_daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.daily_volume(V.tx(spark, sf)))


def q_fraud_rate_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.fraud_rate_by_period(V.tx(spark, sf), period="year"))


def q_label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return eda.label_coverage(V.tx(spark, sf))


def q_volume_by_hour_dow(spark: SparkSession, sf: str) -> DataFrame:
    return eda.volume_by_hour_dow(V.tx(spark, sf))


def q_amount_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.amount_histogram(V.tx(spark, sf), "amount", 60))


def q_box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.box_stats(V.tx(spark, sf), ["amount", "p"]))


def q_trim_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.trim_quantiles(V.tx(spark, sf), "amount").select("id", "amount"))


def q_corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.corr_matrix(V.tx(spark, sf), ["amount", "p", "merchant_id", "is_fraud"]))


def q_alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return eda.alert_counts(risk_level(V.tx(spark, sf), "p"))


QUERIES = {
    "scan_tx": q_scan_tx, "labeled_scan": q_labeled_scan, "static_tx": q_static_tx,
    "parse_currency": q_parse_currency, "parse_bool": q_parse_bool, "parse_month_year": q_parse_month_year,
    "acct_age": q_acct_age, "time_features": q_time_features, "parse_yes_no": q_parse_yes_no,
    "static_cards": q_static_cards, "static_users": q_static_users, "gold_join": q_gold_join,
    "gold_table": q_gold_table, "label_attach": q_label_attach, "label_join": q_label_join, "ref_integrity": q_ref_integrity, "time_split": q_time_split,
    "split_rates": q_split_rates, "sample_entities": q_sample_entities,
    "stratified_sample": q_stratified_sample, "risk_level": q_risk_level, "feature_fill": q_feature_fill, "prepare_matrix": q_prepare_matrix,
    "sample_rows": q_sample_rows, "sample_by_label": q_sample_by_label, "splits_saved": q_splits_saved,
    "gold_published": q_gold_published,
    "payload_to_features": q_payload_to_features, "missing_rate": q_missing_rate,
    "numeric_summary": q_numeric_summary, "categorical_summary": q_categorical_summary,
    "schema_audit": q_schema_audit, "dq_checks": q_dq_checks, "daily_volume": q_daily_volume,
    "fraud_rate_by_year": q_fraud_rate_by_year, "label_coverage": q_label_coverage,
    "volume_by_hour_dow": q_volume_by_hour_dow, "amount_histogram": q_amount_histogram,
    "box_stats": q_box_stats, "trim_quantiles": q_trim_quantiles, "corr_matrix": q_corr_matrix, "alert_counts": q_alert_counts,
}

__all__ = ["ACTIONS", "QUERIES", "TX_SPLITS", "DRIFT_CUT"]
