"""Star join into the gold table and the static preparation
steps (P1-P3, F4, F5).

Join strategy: the fact table is never shuffled for a dimension whose size
is proven small.  ``broadcast_if_small`` asks Catalyst for the optimized
plan's size estimate and only then adds a broadcast hint; above the bound
the join stays a plain equi-join (sort-merge, or AQE's runtime broadcast
when the actual shuffle output turns out small).  Labels (as many rows as
labeled transactions) are always a shuffle join on the long id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.functions.timecols import col_of

BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. Spark Connect)
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def assert_unique_key(df: DataFrame, key: str, sample: int = 5) -> None:
    """Fail before a left join can multiply fact rows (J4 invariant).
    Runs one aggregation; only up to ``sample`` offending keys reach the driver."""
    dups = df.groupBy(key).count().where("count > 1").limit(sample).collect()
    if dups:
        raise ValueError(f"duplicate {key} in dimension: {[r[key] for r in dups]}")


# -- static preparation -----------------------------------------------------

def add_time_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """hour_of_day, day_of_week (Mon=0), is_weekend, month, is_night (hour 0-4).
    Flags are 0 when the date is NULL."""
    d = F.col(date_col)
    hour = F.hour(d)
    dow = S.weekday_mon0(d)
    return df.select(
        "*",
        hour.alias("hour_of_day"),
        dow.alias("day_of_week"),
        F.coalesce((dow >= 5).cast("int"), F.lit(0)).alias("is_weekend"),
        F.month(d).alias("month"),
        F.coalesce(((hour >= 0) & (hour < 5)).cast("int"), F.lit(0)).alias("is_night"),
    )


def prepare_static_transaction(df: DataFrame, amount_col: str = "amount",
                               date_col: str = "date") -> DataFrame:
    """Parse the amount when it is a string, add time features. Idempotent."""
    out = df
    if dict(df.dtypes).get(amount_col) == "string":
        out = out.withColumn(amount_col, S.parse_currency(amount_col))
    return add_time_features(out, date_col)


def _nonneg(c) -> F.Column:
    x = col_of(c)
    return F.when(x >= 0, x)


def prepare_cards(df: DataFrame) -> DataFrame:
    """credit_limit parsed, negative -> NULL; acct_open_date 'MM/yyyy'; bool flags."""
    out = df
    types = dict(df.dtypes)
    if "credit_limit" in types:
        cl = S.parse_currency("credit_limit") if types["credit_limit"] == "string" else F.col("credit_limit")
        out = out.withColumn("credit_limit", _nonneg(cl).cast("double"))
    if "acct_open_date" in types and types["acct_open_date"] == "string":
        out = out.withColumn("acct_open_date", S.parse_month_year("acct_open_date"))
    for c in ("has_chip", "card_on_dark_web"):
        if c in types:
            out = out.withColumn(c, S.parse_bool_flag(c))
    return out


USER_MONEY = ("per_capita_income", "yearly_income", "total_debt")


def prepare_users(df: DataFrame) -> DataFrame:
    """Money columns parsed, negative -> NULL."""
    out = df
    types = dict(df.dtypes)
    for c in USER_MONEY:
        if c in types:
            v = S.parse_currency(c) if types[c] == "string" else F.col(c)
            out = out.withColumn(c, _nonneg(v).cast("double"))
    return out


def add_acct_age_days(df: DataFrame, date_col: str = "date", open_col: str = "acct_open_date",
                      out_col: str = "acct_age_days") -> DataFrame:
    if open_col not in df.columns or date_col not in df.columns:
        return df
    return df.withColumn(out_col, S.acct_age_days(date_col, open_col))


# -- joins ------------------------------------------------------------------

def _suffix_collisions(left: DataFrame, right: DataFrame, suffix: str) -> DataFrame:
    taken = set(left.columns)
    return right.select(*[F.col(c).alias(c + suffix if c in taken else c) for c in right.columns])


def join_dimension(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                   suffix: str, max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Left equi-join, colliding dimension columns get ``suffix``."""
    d = _suffix_collisions(fact, dim, suffix)
    dk = dim_key + suffix if dim_key in fact.columns else dim_key
    d = broadcast_if_small(d, max_broadcast_bytes)
    return fact.join(d, fact[fact_key] == d[dk], "left")


def attach_labels(fact: DataFrame, labels: DataFrame, id_col: str = "id", validate: bool = True) -> DataFrame:
    """Left join on the long id; ``has_label`` = label present.
    labels: (transaction_id long, is_fraud int).  Duplicate label ids, which
    would multiply rows, are an error (``validate=False`` skips that check)."""
    if validate:
        assert_unique_key(labels, "transaction_id")
    lab = labels.select(F.col("transaction_id").alias("__lid"), F.col("is_fraud").cast("int").alias("is_fraud"))
    j = fact.join(lab, fact[id_col] == lab["__lid"], "left")
    return (j.withColumn("transaction_id_str", F.col(id_col).cast("string"))
             .withColumn("has_label", F.col("is_fraud").isNotNull())
             .drop("__lid"))


def build_gold_table(transactions: DataFrame, cards: DataFrame, users: DataFrame,
                     mcc: DataFrame, labels: DataFrame, *, parse_static: bool = True,
                     validate: bool = True) -> DataFrame:
    """Transactions (+time features) -> cards (+acct_age_days) -> users ->
    MCC descriptions -> labels; one lazy plan, one row per transaction.
    Duplicate keys in a dimension or among the labels are an error
    (``validate=False`` skips these aggregations)."""
    t = transactions
    if parse_static:
        t = prepare_static_transaction(t)
        cards = prepare_cards(cards)
        users = prepare_users(users)
    if validate:
        assert_unique_key(cards, "id")
        assert_unique_key(users, "id")
        assert_unique_key(mcc, "mcc_str")
    t = join_dimension(t, cards, "card_id", "id", "_card")
    if parse_static:
        t = add_acct_age_days(t)
    t = join_dimension(t, users, "client_id", "id", "_user")
    t = t.withColumn("mcc_str", F.col("mcc").cast("string"))
    m = broadcast_if_small(mcc.select(F.col("mcc_str").alias("__mcc"), "mcc_description"))
    t = t.join(m, t["mcc_str"] == m["__mcc"], "left").drop("__mcc")
    return attach_labels(t, labels, validate=validate)


def star_join_orders(orders: DataFrame, customer: DataFrame, nation: DataFrame,
                     region: DataFrame) -> DataFrame:
    """Driver-data star join (``fact_orders``): orders -> customer -> nation -> region.
    customer.c_acctbal plays credit_limit (negative -> NULL)."""
    o = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"),
                      F.col("o_custkey").alias("client_id"), F.col("o_totalprice").alias("amount"),
                      F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    c = customer.select(F.col("c_custkey").alias("__ck"), F.col("c_name").alias("name"),
                        F.col("c_mktsegment").alias("segment"),
                        _nonneg("c_acctbal").alias("credit_limit"), F.col("c_nationkey").alias("__nk"))
    n = nation.select(F.col("n_nationkey").alias("__nk2"), F.col("n_name").alias("nation"),
                      F.col("n_regionkey").alias("__rk"))
    r = region.select(F.col("r_regionkey").alias("__rk2"), F.col("r_name").alias("region"))
    j = o.join(broadcast_if_small(c), o["client_id"] == c["__ck"], "left")
    j = j.join(broadcast_if_small(n), j["__nk"] == n["__nk2"], "left")
    j = j.join(broadcast_if_small(r), j["__rk"] == r["__rk2"], "left")
    return j.drop("__ck", "__nk", "__nk2", "__rk", "__rk2")


def label_coverage_join(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """J4 on driver data: documents -> labels, has_label = quality IS NOT NULL."""
    lab = labels.select(F.col("doc_id").alias("__did"), "quality", "toxic")
    j = documents.select("doc_id", "lang", "source", "n_chars") \
        .join(lab, F.col("doc_id") == F.col("__did"), "left")
    return j.drop("__did").withColumn("has_label", F.col("quality").isNotNull())


def referential_integrity(child: DataFrame, parent: DataFrame, child_key: str,
                          parent_key: str) -> DataFrame:
    """How many child rows find their key in the parent.  One left join
    against the distinct parent keys (cannot multiply rows) and one aggregate."""
    p = parent.select(F.col(parent_key).alias("__pk")).distinct().withColumn("__hit", F.lit(1))
    j = child.join(p, F.col(child_key) == F.col("__pk"), "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count("__hit").alias("n_matched"),
                 F.count_if(F.col("__hit").isNull()).alias("n_orphan"))
