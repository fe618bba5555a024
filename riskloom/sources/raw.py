"""Raw domain sources with declared schemas.

* CSVs are read with a fixed StructType (no inference pass), PERMISSIVE mode.
* The MCC map is a small JSON object (flat, or nested under "root").
* The fraud-label file is ONE large JSON object ``{"target": {"id": "Yes", ...}}``.
  Parsing it as a single record would put the whole file in one task; it is
  read instead as text split on "," (splittable), and each piece yields at
  most one ``"id": "value"`` pair via a regular expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import parse_yes_no
from riskloom.schemas import CARDS_SCHEMA, TRANSACTIONS_SCHEMA, USERS_SCHEMA


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("escape", '"').csv(path))


def load_transactions(spark: SparkSession, path: str, nrows: int | None = None,
                      parse_dates: bool = True) -> DataFrame:
    """Transactions CSV; ``date`` parsed (bad -> NULL); optional first N rows by id."""
    df = _csv(spark, path, TRANSACTIONS_SCHEMA)
    if parse_dates:
        df = df.withColumn("date", F.try_to_timestamp(F.col("date")))
    if nrows is not None:
        df = df.orderBy("id").limit(nrows)
    return df


def load_cards(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return _csv(spark, path, CARDS_SCHEMA)


def load_users(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return _csv(spark, path, USERS_SCHEMA)


def load_mcc_codes(spark: SparkSession, path: str) -> DataFrame:
    """(mcc_str, mcc_description) from a flat or "root"-nested JSON object."""
    txt = spark.read.option("wholetext", True).text(path)
    m = F.from_json(F.col("value"), "map<string,string>")
    nested = F.from_json(F.get_json_object(F.col("value"), "$.root"), "map<string,string>")
    mp = F.when(F.get_json_object(F.col("value"), "$.root").isNotNull(), nested).otherwise(m)
    return txt.select(F.explode(mp).alias("mcc_str", "mcc_description"))


PAIR = r'"(\d+)"\s*:\s*"([^"]*)"'


def load_fraud_labels(spark: SparkSession, path: str) -> DataFrame:
    """S5 + F6: (transaction_id long, is_fraud int) with Yes -> 1, anything else -> 0."""
    pieces = spark.read.option("lineSep", ",").text(path)
    kv = pieces.select(F.regexp_extract("value", PAIR, 1).alias("k"), F.regexp_extract("value", PAIR, 2).alias("v"))
    return kv.where(F.col("k") != "").select(F.col("k").cast("long").alias("transaction_id"),
                                            parse_yes_no(F.col("v")).alias("is_fraud"))
