"""DuckDB twins for riskloom.plans.q_data."""

from __future__ import annotations

from riskloom.config import ACTIONS
from riskloom.plans.views import FACT_ORDERS_SQL, TX_SQL

R = 6
SPLIT_CASE = ("CASE WHEN date <= TIMESTAMP '2024-01-20' THEN 'train' "
              "WHEN date > TIMESTAMP '2024-01-20' AND date <= TIMESTAMP '2024-01-25' THEN 'val' "
              "WHEN date >= TIMESTAMP '2024-01-26' THEN 'test' END")
LEVEL = "CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"
CARDS_RAW = """cards_raw AS (
  SELECT c_custkey AS id,
         CASE WHEN c_acctbal < 0 THEN '$-' ELSE '$' END || format('{:,.2f}', abs(c_acctbal)) AS credit_limit,
         lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || '/1995' AS acct_open_date,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'YES' WHEN 'AUTOMOBILE' THEN ' true '
              WHEN 'MACHINERY' THEN 'Y' WHEN 'HOUSEHOLD' THEN 'no' ELSE '0' END AS has_chip
  FROM customer)"""


def _money(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '$-' ELSE '$' END || format('{{:,.2f}}', abs({x}))"


def _parse_money(x: str) -> str:
    return f"TRY_CAST(regexp_replace({x}, '[$,\\s]', '', 'g') AS DOUBLE)"


def _month_year(x: str) -> str:
    return f"try_strptime(trim({x}), '%m/%Y')"


def _flag(x: str) -> str:
    return f"CAST(coalesce(upper(trim({x})) IN ('YES', 'TRUE', '1', 'Y'), false) AS INTEGER)"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_tx"] = (f"WITH {TX_SQL} SELECT id, date, client_id, card_id, merchant_id, mcc_str, card_brand, "
                    f"round(amount, {R}) AS amount, amount_raw, has_label, is_fraud, round(p, {R}) AS p FROM tx")
    q["labeled_scan"] = (f"WITH {TX_SQL} SELECT id, is_fraud, round(amount, {R}) AS amount FROM tx "
                         "WHERE has_label AND is_fraud IS NOT NULL")
    q["static_tx"] = f"""WITH {TX_SQL}
SELECT id, round({_parse_money('amount_raw')}, {R}) AS amount,
  CAST(hour(date) AS INTEGER) AS hour_of_day, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend, CAST(month(date) AS INTEGER) AS month,
  CAST(hour(date) < 5 AS INTEGER) AS is_night
FROM tx"""
    q["time_features"] = q["static_tx"].replace(f"round({_parse_money('amount_raw')}, {R}) AS amount,", "")
    q["parse_currency"] = f"""WITH {TX_SQL},
v AS (SELECT id, CASE mcc_str WHEN 'view' THEN ' ' || amount_raw || ' '
                 WHEN 'click' THEN regexp_replace(amount_raw, '^\\$', '$-')
                 WHEN 'purchase' THEN '$' || format('{{:,.2f}}', amount * 1000)
                 WHEN 'error' THEN 'n/a' || amount_raw ELSE amount_raw END AS raw FROM tx)
SELECT id, raw, round({_parse_money('raw')}, {R}) AS parsed FROM v"""
    q["parse_bool"] = f"WITH {CARDS_RAW} SELECT id, has_chip, {_flag('has_chip')} AS flag FROM cards_raw"
    q["parse_month_year"] = f"""WITH r AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '13/' || CAST(year(o_orderdate) AS VARCHAR)
         ELSE strftime(o_orderdate, '%m/%Y') END AS raw FROM orders)
SELECT id, raw, {_month_year('raw')} AS parsed FROM r"""
    q["acct_age"] = f"""WITH {FACT_ORDERS_SQL}, {CARDS_RAW},
c AS (SELECT id AS cid, {_month_year('acct_open_date')} AS opened FROM cards_raw)
SELECT f.id, CASE WHEN c.opened IS NOT NULL AND f.date IS NOT NULL THEN
  greatest(0, CAST(floor((epoch_us(f.date) - epoch_us(c.opened)) / 86400000000.0) AS BIGINT)) END AS acct_age_days
FROM fact_orders f LEFT JOIN c ON f.client_id = c.cid"""
    q["parse_yes_no"] = """SELECT doc_id,
  CAST(coalesce(lower(trim(CASE WHEN quality = 1 THEN ' Yes' ELSE 'no ' END)) = 'yes', false) AS INTEGER) AS quality_flag,
  CAST(coalesce(lower(trim(CASE WHEN toxic = 1 THEN 'YES ' ELSE 'No' END)) = 'yes', false) AS INTEGER) AS toxic_flag
FROM labels"""
    q["static_cards"] = f"""WITH {CARDS_RAW}
SELECT id, round(CASE WHEN {_parse_money('credit_limit')} >= 0 THEN {_parse_money('credit_limit')} END, {R}) AS credit_limit,
  {_month_year('acct_open_date')} AS acct_open_date, {_flag('has_chip')} AS has_chip
FROM cards_raw"""
    users = []
    for name, expr in (("yearly_income", "s_acctbal"), ("per_capita_income", "s_acctbal / 10"),
                       ("total_debt", "s_acctbal - 5000")):
        pm = _parse_money(_money(expr))
        users.append(f"round(CASE WHEN {pm} >= 0 THEN {pm} END, {R}) AS {name}")
    q["static_users"] = f"SELECT s_suppkey AS id, {', '.join(users)} FROM supplier"
    day = "CAST(o_orderdate AS TIMESTAMP)"
    opened = _month_year("acct_open_date")
    q["gold_table"] = f"""WITH {CARDS_RAW},
c AS (SELECT id AS cid, CASE WHEN {_parse_money('credit_limit')} >= 0 THEN {_parse_money('credit_limit')} END AS credit_limit,
        {_flag('has_chip')} AS has_chip, {opened} AS opened FROM cards_raw),
u AS (SELECT s_suppkey AS sid, {', '.join(users)} FROM supplier)
SELECT o_orderkey AS id, o_custkey AS card_id, o_orderkey % 120 + 1 AS client_id, round(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE), {R}) AS amount,
  CAST(hour({day}) AS INTEGER) AS hour_of_day, CAST(isodow({day}) - 1 AS INTEGER) AS day_of_week, CAST(isodow({day}) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(month({day}) AS INTEGER) AS month, CAST(hour({day}) < 5 AS INTEGER) AS is_night, round(credit_limit, {R}) AS credit_limit, has_chip,
  CASE WHEN opened IS NOT NULL THEN greatest(0, CAST(floor((epoch_us({day}) - epoch_us(opened)) / 86400000000.0) AS BIGINT)) END AS acct_age_days,
  yearly_income, per_capita_income, total_debt, CAST(o_orderkey % 27 AS VARCHAR) AS mcc_str, n_name AS mcc_description,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderpriority = '1-URGENT' AS INTEGER) END AS is_fraud,
  CAST(o_orderkey AS VARCHAR) AS transaction_id_str, o_orderstatus <> 'P' AS has_label
FROM orders LEFT JOIN c ON cid = o_custkey LEFT JOIN u ON sid = o_orderkey % 120 + 1 LEFT JOIN nation ON n_nationkey = o_orderkey % 27"""
    q["label_attach"] = """SELECT o_orderkey AS id, o_custkey AS card_id,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderpriority = '1-URGENT' AS INTEGER) END AS is_fraud,
  CAST(o_orderkey AS VARCHAR) AS transaction_id_str, o_orderstatus <> 'P' AS has_label FROM orders"""
    q["gold_join"] = (f"WITH {FACT_ORDERS_SQL} SELECT id, date, client_id, round(amount, {R}) AS amount, status, "
                      f"priority, name, segment, round(credit_limit, {R}) AS credit_limit, nation, region "
                      "FROM fact_orders")
    q["label_join"] = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.quality IS NOT NULL AS has_label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    q["ref_integrity"] = """
SELECT count(*) AS n_rows, count(c.c_custkey) AS n_matched, count(*) - count(c.c_custkey) AS n_orphan,
       'orders->customer' AS "check"
FROM orders o LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) c ON o.o_custkey = c.c_custkey
UNION ALL
SELECT count(*), count(n.n_nationkey), count(*) - count(n.n_nationkey), 'customer->nation'
FROM customer c LEFT JOIN (SELECT DISTINCT n_nationkey FROM nation) n ON c.c_nationkey = n.n_nationkey"""
    q["time_split"] = f"WITH {TX_SQL} SELECT id, {SPLIT_CASE} AS split FROM tx"
    q["split_rates"] = f"""WITH {TX_SQL}, s AS (SELECT *, {SPLIT_CASE} AS split FROM tx),
k AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) v(split))
SELECT k.split, count(s.id) AS rows, count(s.id) FILTER (WHERE s.has_label) AS labeled_rows,
  CAST(coalesce(sum(s.is_fraud) FILTER (WHERE s.has_label), 0) AS BIGINT) AS fraud_count,
  round(coalesce(CAST(sum(s.is_fraud) FILTER (WHERE s.has_label) AS DOUBLE)
        / nullif(count(s.id) FILTER (WHERE s.has_label), 0), 0.0), {R}) AS fraud_rate
FROM k LEFT JOIN s ON s.split = k.split GROUP BY k.split"""
    q["sample_entities"] = f"""WITH {TX_SQL},
pick AS (SELECT card_id FROM (SELECT DISTINCT card_id FROM tx WHERE card_id IS NOT NULL)
         ORDER BY md5('42:' || CAST(card_id AS VARCHAR)), card_id LIMIT 50)
SELECT id, card_id FROM tx WHERE card_id IN (SELECT card_id FROM pick)"""
    q["stratified_sample"] = f"""WITH {TX_SQL}, lab AS (SELECT * FROM tx WHERE has_label)
SELECT id, is_fraud FROM lab WHERE is_fraud = 1
UNION ALL
(SELECT id, is_fraud FROM lab WHERE is_fraud = 0
 ORDER BY md5('42:' || CAST(id AS VARCHAR)), id
 LIMIT greatest(0, 2000 - (SELECT count(*) FROM lab WHERE is_fraud = 1)))"""
    q["risk_level"] = f"""WITH {TX_SQL}
SELECT id, round(round(p, 6), {R}) AS risk_score, {LEVEL} AS level,
  CASE WHEN p >= 0.7 THEN '{ACTIONS["HIGH"]}' WHEN p >= 0.3 THEN '{ACTIONS["MEDIUM"]}' ELSE '{ACTIONS["LOW"]}' END AS action
FROM tx"""
    q["feature_fill"] = f"""WITH j AS ({q['label_join']})
SELECT doc_id, coalesce(nullif(lang, 'nan'), '__missing__') AS lang,
  coalesce(nullif(source, 'nan'), '__missing__') AS source,
  coalesce(CAST(quality AS DOUBLE), -999.0) AS quality, coalesce(CAST(toxic AS DOUBLE), -999.0) AS toxic,
  coalesce(CAST(n_chars AS DOUBLE), -999.0) AS n_chars
FROM j"""
    q["prepare_matrix"] = f"""WITH j AS ({q['label_join']})
SELECT doc_id, coalesce(nullif(lang, 'nan'), '__missing__') AS lang, coalesce(nullif(source, 'nan'), '__missing__') AS source,
  coalesce(CAST(quality AS DOUBLE), -999.0) AS quality, coalesce(CAST(n_chars AS DOUBLE), -999.0) AS n_chars,
  -999.0 AS absent_number, '__missing__' AS absent_text FROM j"""
    q["sample_rows"] = f"WITH {TX_SQL} SELECT id FROM tx ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 100"
    q["sample_by_label"] = (f"WITH {TX_SQL} SELECT id, is_fraud FROM tx WHERE is_fraud = 1 "
                            "ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 1")
    q["splits_saved"] = f"WITH {TX_SQL} SELECT id, coalesce({SPLIT_CASE}, 'unassigned') AS split FROM tx"
    q["gold_published"] = f"WITH {TX_SQL} SELECT id, date, round(amount, {R}) AS amount, has_label FROM tx"
    q["payload_to_features"] = """SELECT event_id AS id,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -999.0) AS k,
  coalesce(TRY_CAST(json_extract_string(props, '$.z') AS DOUBLE), -999.0) AS z
FROM events"""
    # -- profiling
    q["missing_rate"] = f"""WITH j AS ({q['label_join']})
SELECT 'quality' AS "column", round(avg(CAST(quality IS NULL AS DOUBLE)), {R}) AS missing_rate FROM j
UNION ALL SELECT 'toxic', round(avg(CAST(toxic IS NULL AS DOUBLE)), {R}) FROM j
UNION ALL SELECT 'lang', round(avg(CAST(lang IS NULL AS DOUBLE)), {R}) FROM j
UNION ALL SELECT 'n_chars', round(avg(CAST(n_chars IS NULL AS DOUBLE)), {R}) FROM j"""
    parts = []
    for c in ("amount", "p", "merchant_id"):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, round(avg({x}), {R}) AS mean,
  round(stddev_samp({x}), {R}) AS std, round(min({x}), {R}) AS min,
  round(quantile_cont({x}, 0.25), {R}) AS p25, round(quantile_cont({x}, 0.5), {R}) AS p50,
  round(quantile_cont({x}, 0.75), {R}) AS p75, round(max({x}), {R}) AS max FROM tx""")
    q["numeric_summary"] = f"WITH {TX_SQL} " + " UNION ALL ".join(parts)
    parts = []
    for c in ("mcc_str", "card_brand", "merchant_id"):
        parts.append(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count
FROM tx GROUP BY 2""")
    q["categorical_summary"] = f"""WITH {TX_SQL}, c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT *, sum(count) OVER (PARTITION BY "column") AS tot,
             row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS FIRST) AS rank FROM c)
SELECT "column", value, count, round(round(count * 100.0 / tot, 2), {R}) AS pct, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 15"""
    cols = [("id", "bigint", True), ("date", "timestamp_ntz", False), ("client_id", "bigint", True),
            ("amount", "double", True), ("status", "string", False), ("priority", "string", False),
            ("name", "string", False), ("segment", "string", False), ("credit_limit", "double", True),
            ("nation", "string", False), ("region", "string", False)]
    parts = []
    for c, t, num in cols:
        rng = (f"round(CAST(min({c}) AS DOUBLE), {R}), round(CAST(max({c}) AS DOUBLE), {R})" if num
               else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
        parts.append(f"SELECT '{c}', '{t}', count(*) - count({c}), "
                     f"round(round(100.0 * (count(*) - count({c})) / nullif(count(*), 0), 2), {R}), "
                     f"count(DISTINCT {c}), {rng} FROM fact_orders")
    q["schema_audit"] = (f"WITH {FACT_ORDERS_SQL}, a(\"column\", dtype, null_count, null_pct, cardinality, min_num, "
                         f"max_num) AS ({' UNION ALL '.join(parts)}) SELECT * FROM a")
    q["dq_checks"] = f"""WITH {TX_SQL}
SELECT count(*) AS n_rows, count(*) - count(DISTINCT id) AS duplicate_ids,
  round(round(count(DISTINCT id) / count(*), 4), {R}) AS unique_id_ratio,
  count(*) FILTER (WHERE date IS NULL) AS null_dates,
  count(*) FILTER (WHERE date > TIMESTAMP '2024-01-29') AS future_dates,
  min(date) AS date_min, max(date) AS date_max,
  count(*) FILTER (WHERE {_parse_money('amount_raw')} IS NULL) AS null_amounts,
  count(*) FILTER (WHERE {_parse_money('amount_raw')} < 0) AS negative_amounts,
  count(*) FILTER (WHERE {_parse_money('amount_raw')} = 0) AS zero_amounts
FROM tx"""
    q["daily_volume"] = (f"WITH {TX_SQL} SELECT CAST(date AS DATE) AS day, count(*) AS n, "
                         f"round(sum(amount), {R}) AS amount_sum FROM tx GROUP BY 1")
    q["fraud_rate_by_year"] = f"""WITH {TX_SQL}
SELECT CAST(year(date) AS INTEGER) AS year, count(is_fraud) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud,
  round(sum(is_fraud) * 100.0 / count(is_fraud), {R}) AS fraud_rate
FROM tx WHERE has_label AND is_fraud IS NOT NULL GROUP BY 1"""
    q["label_coverage"] = f"""WITH {TX_SQL}
SELECT 'has_label' AS dimension, 'true' AS value, count(*) FILTER (WHERE has_label) AS n FROM tx
UNION ALL SELECT 'has_label', 'false', count(*) FILTER (WHERE NOT has_label) FROM tx
UNION ALL SELECT 'is_fraud', '1', count(*) FILTER (WHERE has_label AND is_fraud = 1) FROM tx
UNION ALL SELECT 'is_fraud', '0', count(*) FILTER (WHERE has_label AND is_fraud = 0) FROM tx"""
    q["volume_by_hour_dow"] = f"""WITH {TX_SQL}
SELECT 'hour' AS kind, CAST(hour(date) AS INTEGER) AS key, count(*) AS n FROM tx GROUP BY 2
UNION ALL SELECT 'dow', CAST(isodow(date) - 1 AS INTEGER), count(*) FROM tx GROUP BY 2"""
    q["amount_histogram"] = f"""WITH {TX_SQL},
b AS (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM tx),
w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 60 ELSE 1.0 END AS width FROM b),
t AS (SELECT least(CAST(floor((amount - lo) / width) AS INTEGER), 59) AS bin, lo, width
      FROM tx, w WHERE amount BETWEEN lo AND hi)
SELECT bin, round(any_value(lo) + bin * any_value(width), {R}) AS bin_lo,
       round(any_value(lo) + (bin + 1) * any_value(width), {R}) AS bin_hi, count(*) AS n
FROM t GROUP BY bin"""
    parts = []
    for c in ("amount", "p"):
        parts.append(f"""SELECT '{c}' AS "column", round(any_value(q1), {R}) AS q1, round(any_value(q2), {R}) AS median,
  round(any_value(q3), {R}) AS q3, round(min({c}) FILTER (WHERE inside), {R}) AS whisker_lo,
  round(max({c}) FILTER (WHERE inside), {R}) AS whisker_hi, count(*) FILTER (WHERE NOT inside) AS n_outliers,
  round(min({c}), {R}) AS min, round(max({c}), {R}) AS max
FROM (SELECT {c}, q1, q2, q3, {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM tx, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM tx))""")
    q["box_stats"] = f"WITH {TX_SQL} " + " UNION ALL ".join(parts)
    q["trim_quantiles"] = f"""WITH {TX_SQL},
b AS (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM tx)
SELECT id, round(amount, {R}) AS amount FROM tx, b WHERE amount BETWEEN lo AND hi"""
    cc = ["amount", "p", "merchant_id", "is_fraud"]
    parts = []
    for i, a in enumerate(cc):
        for b in cc[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {R}) AS corr FROM tx")
    q["corr_matrix"] = f"WITH {TX_SQL} " + " UNION ALL ".join(parts)
    q["alert_counts"] = f"WITH {TX_SQL} SELECT {LEVEL} AS level, count(*) AS n FROM tx GROUP BY 1"
    return q
