"""DuckDB twins of the registered queries (independent formulations).

Windows are checked by brute force (self-join over the past rows), metrics
by textbook SQL; every floating output is rounded to 6 digits on both sides.
"""

from __future__ import annotations

from riskloom.config import DEFAULT_WINDOWS
from riskloom.plans.views import FACT_ORDERS_SQL, SCORED_SQL, TX_SQL

R = 6  # rounding digits shared with queries.rounded()


def _velocity_sql(source_cte: str, src: str, entity: str, prefix: str, windows=None,
                  with_distinct: bool = True, z: bool = False, strict: bool = False) -> str:
    """Brute force: pair every row with the earlier rows of its entity that lie
    inside the longest window, then filter per window."""
    wins = windows or DEFAULT_WINDOWS
    w_max = max(wins.values())
    before = "b.date < a.date" if strict else "(b.date < a.date OR (b.date = a.date AND b.id < a.id))"
    sel = []
    for label, sec in wins.items():
        f = f"FILTER (WHERE p.dt <= {sec * 1_000_000})"
        sel += [
            f"count(p.id) {f} AS {prefix}_tx_count_{label}",
            f"round(coalesce(sum(p.amount) {f}, 0.0), {R}) AS {prefix}_amount_sum_{label}",
            f"round(sum(p.amount) {f} / nullif(count(p.amount) {f}, 0), {R}) AS {prefix}_amount_mean_{label}",
            f"round(max(p.amount) {f}, {R}) AS {prefix}_amount_max_{label}",
        ]
        if with_distinct:
            sel += [f"count(DISTINCT p.merchant_id) {f} AS {prefix}_unique_merchants_{label}",
                    f"count(DISTINCT p.mcc_str) {f} AS {prefix}_unique_mcc_{label}"]
    if z:
        zf = "FILTER (WHERE p.dt <= 604800000000)"
        sel.append(
            f"round(CASE WHEN count(p.amount) {zf} = 0 THEN NULL ELSE "
            f"(any_value(a.amount) - avg(p.amount) {zf}) / "
            f"(coalesce(CASE WHEN count(p.amount) {zf} >= 2 THEN stddev_samp(p.amount) {zf} END, 0.0) + 1e-6) END, 4) + 0.0"
            " AS z_score_amount")
    return f"""WITH {source_cte},
pairs AS (
  SELECT a.id AS aid, b.id, b.amount, b.merchant_id, b.mcc_str,
         epoch_us(a.date) - epoch_us(b.date) AS dt
  FROM {src} a JOIN {src} b
    ON a.{entity} = b.{entity} AND {before}
   AND epoch_us(b.date) >= epoch_us(a.date) - {w_max * 1_000_000}
)
SELECT a.id, {", ".join(sel)}
FROM {src} a LEFT JOIN pairs p ON p.aid = a.id
GROUP BY a.id"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["velocity_user"] = _velocity_sql(TX_SQL, "tx", "client_id", "user")
    q["velocity_card"] = _velocity_sql(TX_SQL, "tx", "card_id", "card")
    fo = FACT_ORDERS_SQL + """,
fo AS (SELECT id, date, client_id, amount, CAST(NULL AS BIGINT) AS merchant_id, segment AS mcc_str
       FROM fact_orders)"""
    q["velocity_orders_ties"] = _velocity_sql(fo, "fo", "client_id", "cust",
                                              windows={"7d": 604800, "90d": 7776000})
    q["velocity_orders_strict"] = _velocity_sql(fo, "fo", "client_id", "cust",
                                                windows={"7d": 604800, "90d": 7776000}, strict=True)
    for kind in ("tx_count", "amount_sum", "amount_mean", "amount_max", "unique_merchants", "unique_mcc"):
        cols = ", ".join(f"user_{kind}_{lab}" for lab in DEFAULT_WINDOWS)
        q[f"velocity_{kind.replace('tx_', '').replace('amount_', '')}"] = \
            f"WITH v AS ({_velocity_sql(TX_SQL, 'tx', 'client_id', 'user')}) SELECT id, {cols} FROM v"
    q["recency"] = f"""WITH {TX_SQL}
SELECT id,
  round((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY card_id ORDER BY date, id))) / 1e6, {R})
    AS time_since_last_tx_card,
  round((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY client_id ORDER BY date, id))) / 1e6, {R})
    AS time_since_last_tx_user
FROM tx"""
    q["recency_orders"] = f"""WITH {FACT_ORDERS_SQL}
SELECT id,
  round((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY client_id ORDER BY date, id))) / 1e6, {R})
    AS time_since_last_tx_cust
FROM fact_orders"""
    nov = []
    for ent, ep in (("card_id", "card"), ("client_id", "user")):
        for attr, an in (("merchant_id", "merchant"), ("mcc_str", "mcc")):
            nov.append(f"CAST(CASE WHEN {ent} IS NOT NULL AND {attr} IS NOT NULL AND row_number() OVER "
                       f"(PARTITION BY {ent}, {attr} ORDER BY date, id) = 1 THEN 1 ELSE 0 END AS INTEGER) "
                       f"AS first_time_{an}_{ep}")
    q["novelty"] = f"WITH {TX_SQL} SELECT id, {', '.join(nov)} FROM tx"
    q["z_score"] = (f"WITH v AS ({_velocity_sql(TX_SQL, 'tx', 'client_id', 'user', windows={'7d': 604800}, z=True)}) "
                    "SELECT id, z_score_amount FROM v")
    card = _velocity_sql(TX_SQL, "tx", "card_id", "card")
    user = _velocity_sql(TX_SQL, "tx", "client_id", "user", z=True)
    q["behavioral_all"] = f"""WITH c AS ({card}), u AS ({user}), r AS ({q['recency']}), n AS ({q['novelty']})
SELECT * FROM c JOIN u USING (id) JOIN r USING (id) JOIN n USING (id)"""
    ratio = []
    for a, b in (("1h", "24h"), ("24h", "7d")):
        ratio += [f"round(CAST(user_tx_count_{a} AS DOUBLE) / nullif(user_tx_count_{b}, 0), {R}) "
                  f"AS user_count_ratio_{a}_{b}",
                  f"round(user_amount_sum_{a} / nullif(user_amount_sum_{b}, 0), {R}) AS user_amount_ratio_{a}_{b}"]
    q["velocity_ratio"] = f"WITH v AS ({_velocity_sql(TX_SQL, 'tx', 'client_id', 'user')}) " \
                          f"SELECT id, {', '.join(ratio)} FROM v"

    def rate(ent: str, out: str, order: str = "date, id", frame: str = "ROWS") -> str:
        w = f"(PARTITION BY {ent} ORDER BY {order} {frame} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        if frame == "RANGE":
            w = (f"(PARTITION BY {ent} ORDER BY epoch_us(date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        return (f"CASE WHEN {ent} IS NULL THEN NULL ELSE round((coalesce(sum(CASE WHEN has_label THEN "
                f"coalesce(is_fraud, 0) ELSE 0 END) OVER {w}, 0) + 1.0) / (coalesce(sum(CASE WHEN has_label "
                f"THEN 1 ELSE 0 END) OVER {w}, 0) + 10.0), {R}) END AS {out}")
    q["risk_rate_merchant"] = f"WITH {TX_SQL} SELECT id, {rate('merchant_id', 'merchant_historical_fraud_rate')} FROM tx"
    q["risk_rate_mcc"] = f"WITH {TX_SQL} SELECT id, {rate('mcc_str', 'mcc_historical_fraud_rate')} FROM tx"
    q["risk_rate_brand"] = f"WITH {TX_SQL} SELECT id, {rate('card_brand', 'card_brand_historical_fraud_rate')} FROM tx"
    q["risk_rates_all"] = (f"WITH {TX_SQL} SELECT id, {rate('merchant_id', 'merchant_historical_fraud_rate')}, "
                           f"{rate('mcc_str', 'mcc_historical_fraud_rate')}, "
                           f"{rate('card_brand', 'card_brand_historical_fraud_rate')} FROM tx")
    q["risk_rate_orders_strict"] = f"""WITH {FACT_ORDERS_SQL},
fo AS (SELECT *, status <> 'P' AS has_label,
              CASE WHEN status <> 'P' THEN CAST(priority = '1-URGENT' AS INTEGER) END AS is_fraud
       FROM fact_orders)
SELECT id, {rate('segment', 'segment_rate', frame='RANGE')}, {rate('nation', 'nation_rate')} FROM fo"""
    from riskloom.plans import o_data, o_eval, o_ml
    q.update(o_data.build())
    q.update(o_eval.build())
    q.update(o_ml.build())
    return q
