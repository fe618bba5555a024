"""Driver-table views shared by queries() and their DuckDB oracles.

``tx`` maps the ``events`` table onto the transaction schema of the domain;
``fact_orders`` is the star join orders -> customer -> nation -> region;
``scored`` is the labeled part of ``tx`` as (id, y, p).
Each Spark builder has a SQL twin (``*_SQL``) with the same columns, written
so that DuckDB can run it as a CTE over the driver's pre-registered views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Of 2^24 draws of a label, those that are fraud: for large error events, for others.
FRAUD_DRAWS = (10_066_330, 335_544)


def _brand(user_id: Column) -> Column:
    m = F.pmod(user_id, F.lit(4))
    return (F.when(m == 0, "Visa").when(m == 1, "Mastercard")
            .when(m == 2, "Amex").otherwise("Other"))


def tx_from_events(events: DataFrame) -> DataFrame:
    """events -> transaction view (see FIXTURES.md part C)."""
    e = events
    has_label = (F.col("event_id") % 3) != 0
    # Fraud with probability 0.6 for large error events and 0.02 for others: a hash of the id decides,
    # so the features say something about the label and do not determine it.
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("label:"), F.col("event_id").cast("string"))), 1, 6), 16, 10).cast("int")
    bound = F.when((F.col("event_type") == "error") & (F.col("value") > 20), FRAUD_DRAWS[0]).otherwise(FRAUD_DRAWS[1])
    fraud = F.when(has_label, (draw < bound).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("date"),
        F.col("user_id").alias("client_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("card_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("merchant_id"),
        F.col("event_type").alias("mcc_str"),
        _brand(F.col("user_id")).alias("card_brand"),
        F.col("value").alias("amount"),
        F.concat(F.lit("$"), F.col("value").cast("decimal(12,2)").cast("string")).alias("amount_raw"),
        has_label.alias("has_label"),
        fraud.cast("int").alias("is_fraud"),
        (F.floor(F.col("value") / (F.col("value") + 50) * 1000) / 1000).alias("p"),
    )


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_from_events(read_table(spark, sf_dir, "events"))


TX_SQL = f"""
tx AS (
  SELECT event_id AS id, ts AS date, user_id AS client_id,
         user_id * 10 + event_id % 3 AS card_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS merchant_id,
         event_type AS mcc_str,
         CASE user_id % 4 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Mastercard'
                          WHEN 2 THEN 'Amex' ELSE 'Other' END AS card_brand,
         value AS amount,
         '$' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount_raw,
         event_id % 3 <> 0 AS has_label,
         CAST(CASE WHEN event_id % 3 <> 0 THEN CAST('0x' || substr(md5('label:' || CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT)
              < CASE WHEN event_type = 'error' AND value > 20 THEN {FRAUD_DRAWS[0]} ELSE {FRAUD_DRAWS[1]} END END AS INTEGER) AS is_fraud,
         floor(value / (value + 50) * 1000) / 1000 AS p
  FROM events
)"""


def scored_from_tx(t: DataFrame) -> DataFrame:
    return (t.where(F.col("has_label") & F.col("is_fraud").isNotNull())
            .select("id", F.col("is_fraud").alias("y"), "p", "date"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from_tx(tx(spark, sf_dir))


SCORED_SQL = TX_SQL + """,
scored AS (SELECT id, is_fraud AS y, p, date FROM tx WHERE has_label AND is_fraud IS NOT NULL)"""


def fact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> customer -> nation -> region, one row per order."""
    from riskloom.operators import gold
    return gold.star_join_orders(
        read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region"))


FACT_ORDERS_SQL = """
fact_orders AS (
  SELECT o.o_orderkey AS id, o.o_orderdate AS date, o.o_custkey AS client_id,
         o.o_totalprice AS amount, o.o_orderstatus AS status, o.o_orderpriority AS priority,
         c.c_name AS name, c.c_mktsegment AS segment,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS credit_limit,
         n.n_name AS nation, r.r_name AS region
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""
