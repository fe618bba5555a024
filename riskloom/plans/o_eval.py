"""DuckDB twins for riskloom.plans.q_eval (textbook formulations)."""

from __future__ import annotations

from riskloom.plans.views import SCORED_SQL, TX_SQL

R = 6

CANDIDATES = TX_SQL + """,
rt AS (SELECT *, CASE WHEN merchant_id IS NULL THEN NULL ELSE
         (coalesce(sum(CASE WHEN has_label THEN coalesce(is_fraud, 0) ELSE 0 END) OVER wm, 0) + 1.0)
       / (coalesce(sum(CASE WHEN has_label THEN 1 ELSE 0 END) OVER wm, 0) + 10.0) END AS mrate
       FROM tx WINDOW wm AS (PARTITION BY merchant_id ORDER BY date, id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lab AS (SELECT * FROM rt WHERE has_label AND is_fraud IS NOT NULL),
cand AS (SELECT 'toy_p' AS model, id, is_fraud AS y, p FROM lab
         UNION ALL SELECT 'merchant_rate', id, is_fraud, CAST(mrate AS DOUBLE) FROM lab
         UNION ALL SELECT 'amount_squash', id, is_fraud, amount / (amount + 100.0) FROM lab)"""


def _curve(src: str, keys: str) -> str:
    """Per-key curve metrics from the distinct-score table."""
    kcol = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""g AS (SELECT {kcol}p, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src}
       WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY {kcol}p),
c AS (SELECT *, sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
             sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
             sum(pos) OVER ({part}) AS tot_pos, sum(neg) OVER ({part}) AS tot_neg
      FROM g WINDOW w AS ({part} ORDER BY p DESC)),
cm AS (SELECT {kcol}
  sum(pos * cp / (cp + cn)) / nullif(any_value(tot_pos), 0) AS pr_auc,
  sum(pos * ((tot_neg - cn) + neg / 2.0)) / nullif(any_value(tot_pos) * any_value(tot_neg), 0) AS roc_auc,
  CASE WHEN any_value(tot_pos) > 0 THEN coalesce(max(CASE WHEN cp / (cp + cn) >= 0.9 THEN cp / tot_pos END), 0.0) END
    AS recall_at_precision_90,
  CASE WHEN any_value(tot_pos) > 0 AND any_value(tot_neg) > 0 THEN max(abs(cp / tot_pos - cn / tot_neg)) ELSE 0.0 END AS ks_stat
  FROM c {grp})"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    ev = f"""WITH {SCORED_SQL}, {_curve('scored', '')},
b AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(power(p - y, 2)) AS brier FROM scored)
SELECT n, n_pos, round(brier, {R}) AS brier, round(pr_auc, {R}) AS pr_auc, round(roc_auc, {R}) AS roc_auc,
       round(recall_at_precision_90, {R}) AS recall_at_precision_90 FROM b, cm"""
    q["eval_summary"] = ev
    for m in ("pr_auc", "roc_auc", "brier", "recall_at_precision_90"):
        key = "recall_at_precision" if m.startswith("recall") else m
        q[key] = f"SELECT {m} FROM ({ev})"
    cms = []
    for t in (0.3, 0.5, 0.7):
        cms.append(f"""SELECT {t}::DOUBLE AS threshold,
  count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp,
  count(*) FILTER (WHERE p < {t} AND y = 0) AS tn, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn FROM scored""")
    q["confusion_matrix"] = f"""WITH {SCORED_SQL}, m AS ({' UNION ALL '.join(cms)}),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rc FROM m)
SELECT threshold, tp, fp, tn, fn, round(pr, {R}) AS precision, round(rc, {R}) AS recall,
  round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0), {R}) AS f1,
  round(coalesce(tn / nullif(tn + fp, 0), 0.0), {R}) AS specificity FROM r"""
    halves = []
    for h in (0, 1):
        halves.append(f"""SELECT * FROM (WITH w AS (SELECT y, id % 1000 / 1000.0::DOUBLE AS p FROM scored WHERE id % 2 = {h}),
g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM w GROUP BY p),
c AS (SELECT sum(pos) OVER d AS cp, sum(neg) OVER d AS cn, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0 FROM g WINDOW d AS (ORDER BY p DESC)),
k AS (SELECT max(abs(cp / n1 - cn / n0)) AS ks, any_value(n1)::DOUBLE AS n1, any_value(n0)::DOUBLE AS n0 FROM c),
e AS (SELECT ks, sqrt(n1 * n0 / (n1 + n0)) AS en FROM k),
l AS (SELECT ks, (en + 0.12 + 0.11 / en) * ks AS lam FROM e),
grid AS (SELECT i, CASE WHEN i = 199 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 199) END AS t FROM generate_series(0, 199) s(i)),
tot AS (SELECT sum(y) AS tp, count(*) - sum(y) AS tn FROM w),
d AS (SELECT g.i, g.t, count(*) FILTER (WHERE w.y = 1 AND w.p >= g.t) / any_value(tp) - count(*) FILTER (WHERE w.y = 0 AND w.p >= g.t) / any_value(tn) AS d
      FROM grid g, w, tot GROUP BY g.i, g.t)
SELECT round(ks, {R}) AS ks_stat,
  round(least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * lam * lam))))), {R}) AS p_value,
  round((SELECT t FROM d ORDER BY d DESC, i LIMIT 1), {R}) AS ks_threshold, {h} AS half FROM l)""")
    q["ks_test"] = f"WITH {SCORED_SQL} " + " UNION ALL ".join(halves)
    q["ks_stat"] = f"""WITH {SCORED_SQL}, {_curve('scored', '')},
grid AS (SELECT i, CASE WHEN i = 199 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 199) END AS t
         FROM generate_series(0, 199) s(i)),
tot AS (SELECT sum(y) AS tot_pos, count(*) - sum(y) AS tot_neg FROM scored),
d AS (SELECT g.i, g.t, count(*) FILTER (WHERE s.y = 1 AND s.p >= g.t) / any_value(tot.tot_pos)
                     - count(*) FILTER (WHERE s.y = 0 AND s.p >= g.t) / any_value(tot.tot_neg) AS d
      FROM grid g, scored s, tot GROUP BY g.i, g.t),
best AS (SELECT t FROM d ORDER BY d DESC, i LIMIT 1)
SELECT round(cm.ks_stat, {R}) AS ks_stat, round(best.t, {R}) AS ks_threshold FROM cm, best"""
    lift = f"""WITH {SCORED_SQL},
tot AS (SELECT count(*) AS n, sum(y) AS pos FROM scored),
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rn FROM scored),
d AS (SELECT CAST(least((rn - 1) // (tot.n // 10), 9) AS INTEGER) AS dec, y FROM r, tot),
g AS (SELECT CAST(i AS INTEGER) AS dec FROM generate_series(0, 9) s(i)),
l AS (SELECT g.dec + 1 AS decile, count(d.y) AS n, CAST(coalesce(sum(d.y), 0) AS BIGINT) AS n_fraud,
             sum(d.y) / nullif(count(d.y), 0) AS fraud_rate
      FROM g LEFT JOIN d ON g.dec = d.dec GROUP BY g.dec)
SELECT decile, n, n_fraud, fraud_rate, fraud_rate / (SELECT pos / n FROM tot) AS lift FROM l"""
    q["lift_chart"] = f"SELECT decile, n, n_fraud, round(fraud_rate, {R}) AS fraud_rate, round(lift, {R}) AS lift FROM ({lift})"
    q["gain_chart"] = f"""SELECT decile,
  round(sum(n) OVER (ORDER BY decile) / sum(n) OVER (), {R}) AS pct_population,
  round(sum(n_fraud) OVER (ORDER BY decile) / sum(n_fraud) OVER (), {R}) AS pct_fraud_captured
FROM ({lift})"""
    calib = f"""WITH {SCORED_SQL},
e AS (SELECT i, CAST(i AS DOUBLE) * 0.1::DOUBLE AS lo,
             CASE WHEN i + 1 >= 10 THEN 1.0::DOUBLE ELSE CAST(i + 1 AS DOUBLE) * 0.1::DOUBLE END AS hi
      FROM generate_series(0, 9) s(i)),
b AS (SELECT e.i, e.lo, e.hi, s.p, s.y FROM scored s JOIN e
      ON s.p >= e.lo AND (s.p < e.hi OR (e.i = 9 AND s.p <= e.hi))),
c AS (SELECT lo AS bin_lower, hi AS bin_upper, avg(p) AS mean_predicted, avg(CAST(y AS DOUBLE)) AS fraction_positive,
             count(*) AS count FROM b GROUP BY i, lo, hi)"""
    q["calibration_curve"] = (f"{calib} SELECT round(bin_lower, {R}) AS bin_lower, round(bin_upper, {R}) AS bin_upper, "
                              f"round(mean_predicted, {R}) AS mean_predicted, round(fraction_positive, {R}) AS "
                              f"fraction_positive, count FROM c")
    q["ece"] = (f"{calib} SELECT round(coalesce(sum(count * abs(fraction_positive - mean_predicted)) / "
                f"sum(count), 0.0), {R}) AS ece FROM c")
    ml = f"""WITH {CANDIDATES}, {_curve('cand', 'model')},
b AS (SELECT model, avg(power(p - y, 2)) AS brier FROM cand GROUP BY model),
w AS (SELECT model, pr_auc, roc_auc, brier, recall_at_precision_90, ks_stat FROM cm JOIN b USING (model)),
long AS (
  SELECT model, 'pr_auc' AS metric, pr_auc AS value FROM w UNION ALL
  SELECT model, 'roc_auc', roc_auc FROM w UNION ALL SELECT model, 'brier', brier FROM w UNION ALL
  SELECT model, 'recall_at_precision_90', recall_at_precision_90 FROM w UNION ALL
  SELECT model, 'ks_stat', ks_stat FROM w)"""
    q["metrics_table"] = f"{ml} SELECT model, metric, round(value, {R}) AS value FROM long"
    q["metrics_long"] = f"{ml} SELECT model, metric, round(value, {R}) AS value FROM long"
    q["model_leaderboard"] = (f"{ml} SELECT model, round(value, {R}) AS pr_auc, "
                              "CAST(row_number() OVER (ORDER BY value DESC, model) AS INTEGER) AS position "
                              "FROM long WHERE metric = 'pr_auc'")
    q["metric_winners"] = f"""{ml},
rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('brier', 'ece')
                                                            THEN value ELSE -value END) AS r FROM long)
SELECT metric, model, round(value, {R}) AS value FROM rk WHERE r = 1"""
    q["performance_by_period"] = f"""WITH {SCORED_SQL},
s AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS period_start FROM scored WHERE date IS NOT NULL),
{_curve('s', 'period_start')},
k AS (SELECT period_start, count(*) AS n_rows, count(*) FILTER (WHERE p >= 0.7) AS n_high,
             count(*) FILTER (WHERE p >= 0.3 AND p < 0.7) AS n_med,
             count(*) FILTER (WHERE p >= 0.7 AND y = 1) AS fh,
             count(*) FILTER (WHERE p >= 0.3 AND p < 0.7 AND y = 1) AS fm FROM s GROUP BY period_start)
SELECT k.period_start, n_rows, CASE WHEN n_rows >= 10 THEN round(cm.pr_auc, {R}) END AS pr_auc, n_high, n_med,
  CASE WHEN n_rows >= 10 THEN round(fh / nullif(n_high, 0), {R}) END AS precision_high,
  CASE WHEN n_rows >= 10 THEN round(fm / nullif(n_med, 0), {R}) END AS precision_med
FROM k LEFT JOIN cm USING (period_start)"""
    rc = f"""{TX_SQL},
ref AS (SELECT * FROM tx WHERE date < TIMESTAMP '2024-01-16'),
cur AS (SELECT * FROM tx WHERE date >= TIMESTAMP '2024-01-16')"""

    def psi_num(c: str) -> str:
        probs = ", ".join(str(i / 10) for i in range(11))
        return f"""(WITH e AS (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{probs}]))) AS edges
                FROM ref WHERE {c} IS NOT NULL),
rb AS (SELECT least(greatest(len(list_filter(e.edges, lambda v: v <= CAST({c} AS DOUBLE))) - 1, 0), len(e.edges) - 2) AS b
       FROM ref, e WHERE {c} IS NOT NULL),
cb AS (SELECT least(greatest(len(list_filter(e.edges, lambda v: v <= CAST({c} AS DOUBLE))) - 1, 0), len(e.edges) - 2) AS b
       FROM cur, e WHERE {c} IS NOT NULL),
g AS (SELECT i AS b FROM generate_series(0, 9) s(i), e WHERE i < len(e.edges) - 1),
j AS (SELECT g.b, (SELECT count(*) FROM rb WHERE rb.b = g.b) AS rn, (SELECT count(*) FROM cb WHERE cb.b = g.b) AS cn FROM g),
t AS (SELECT sum(rn) AS R, sum(cn) AS C, count(*) AS K FROM j)
SELECT '{c}' AS "column", round(CASE WHEN any_value(t.R) > 0 AND any_value(t.C) > 0 THEN
  sum(((cn + 1e-6) / (t.C + 1e-6 * t.K) - (rn + 1e-6) / (t.R + 1e-6 * t.K))
      * ln(((cn + 1e-6) / (t.C + 1e-6 * t.K)) / ((rn + 1e-6) / (t.R + 1e-6 * t.K)))) END, {R}) AS psi
FROM j, t)"""

    def psi_cat(c: str) -> str:
        k = f"coalesce(nullif(CAST({c} AS VARCHAR), 'nan'), '__missing__')"
        return f"""(WITH rc AS (SELECT {k} AS cat, count(*) AS n FROM ref GROUP BY 1),
cc AS (SELECT {k} AS cat, count(*) AS n FROM cur GROUP BY 1),
j AS (SELECT coalesce(rc.n, 0) AS rn, coalesce(cc.n, 0) AS cn FROM rc FULL OUTER JOIN cc ON rc.cat = cc.cat),
t AS (SELECT sum(rn) AS R, sum(cn) AS C, count(*) AS K FROM j)
SELECT '{c}' AS "column", round(coalesce(sum(((cn + 1e-6) / (t.C + 1e-6 * t.K) - (rn + 1e-6) / (t.R + 1e-6 * t.K))
      * ln(((cn + 1e-6) / (t.C + 1e-6 * t.K)) / ((rn + 1e-6) / (t.R + 1e-6 * t.K)))), 0.0), {R}) AS psi
FROM j, t)"""

    def new_cat(c: str) -> str:
        return f"""(SELECT '{c}' AS "column",
  round(coalesce(count(*) FILTER (WHERE CAST({c} AS VARCHAR) NOT IN
        (SELECT CAST({c} AS VARCHAR) FROM ref WHERE {c} IS NOT NULL)) / nullif(count(*), 0), 0.0), {R}) AS share,
  count(*) FILTER (WHERE CAST({c} AS VARCHAR) NOT IN (SELECT CAST({c} AS VARCHAR) FROM ref WHERE {c} IS NOT NULL))
    AS count_new
FROM cur WHERE {c} IS NOT NULL)"""

    q["psi_numeric"] = f"WITH {rc} {psi_num('amount')} UNION ALL {psi_num('p')}"
    q["psi_categorical"] = f"WITH {rc} {psi_cat('mcc_str')} UNION ALL {psi_cat('card_brand')}"
    q["new_categories"] = f"WITH {rc} {new_cat('merchant_id')} UNION ALL {new_cat('mcc_str')}"
    status = ("CASE WHEN value IS NULL THEN NULL WHEN value < 0.1 THEN 'stable' WHEN value < 0.25 THEN 'moderate' "
              "ELSE 'significant' END")
    miss = " UNION ALL ".join(
        f"SELECT 'missing_rate_current', '{c}', round(avg(CAST({c} IS NULL AS DOUBLE)), {R}) FROM cur"
        for c in ("amount", "card_brand", "mcc_str", "merchant_id"))
    q["drift_report"] = f"""WITH {rc},
psi AS ({psi_num('amount')} UNION ALL {psi_cat('card_brand')} UNION ALL {psi_cat('mcc_str')}),
nc AS ({new_cat('merchant_id')} UNION ALL {new_cat('mcc_str')}),
long(metric, "column", value) AS (
  SELECT 'psi', "column", psi FROM psi UNION ALL {miss}
  UNION ALL SELECT 'new_share', "column", share FROM nc
  UNION ALL SELECT 'count_new', "column", CAST(count_new AS DOUBLE) FROM nc)
SELECT metric, "column", value, CASE WHEN metric = 'psi' THEN {status} END AS status FROM long"""
    return q
