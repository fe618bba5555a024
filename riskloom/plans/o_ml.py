"""DuckDB twins for the deterministic parts of riskloom.plans.q_ml."""

from __future__ import annotations

from riskloom.config import ACTIONS
from riskloom.operators.select import shifts
from riskloom.plans.o_data import SPLIT_CASE
from riskloom.plans.views import SCORED_SQL, TX_SQL

R = 6
LINEAR = ["amount", "p", "merchant_id"]
LABELED = "has_label AND is_fraud IS NOT NULL"


def _isotonic(rows: str) -> str:
    """CTEs: the isotonic fit of is_fraud on p over the labelled validation rows as its max-min formula, and ``cal``:
    the rows of ``rows`` (id, p) with their calibrated, clipped score."""
    return f"""va AS (SELECT p, sum(is_fraud) AS s, count(*) AS n FROM tx WHERE {SPLIT_CASE} = 'val' AND {LABELED} AND p IS NOT NULL GROUP BY p),
vi AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(n) OVER (ORDER BY p) AS cn FROM va),
mean AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM vi a JOIN vi b ON a.i <= b.i),
least_after AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS g FROM mean),
iso AS (SELECT vi.p, max(g) AS value FROM least_after JOIN vi ON vi.i = b GROUP BY vi.p),
cal AS (SELECT id, p, greatest(1e-6, least(1 - 1e-6, CASE WHEN lo_p IS NULL THEN hi_v WHEN hi_p IS NULL OR lo_p = hi_p THEN lo_v
                       ELSE lo_v + (hi_v - lo_v) * (p - lo_p) / (hi_p - lo_p) END)) AS cal
  FROM (SELECT r.id, r.p, l.p AS lo_p, l.value AS lo_v, h.p AS hi_p, h.value AS hi_v
        FROM ({rows}) r ASOF LEFT JOIN iso l ON r.p >= l.p ASOF LEFT JOIN iso h ON r.p <= h.p))"""


def _linear_cte() -> str:
    stats = ", ".join([f"corr(CAST({c} AS DOUBLE), CAST(is_fraud AS DOUBLE)) AS c_{c}" for c in LINEAR]
                      + [f"avg(CAST({c} AS DOUBLE)) AS m_{c}" for c in LINEAR])
    imp = ", ".join(f"st.c_{c} * (CAST(tx.{c} AS DOUBLE) - st.m_{c}) AS impact_{c}" for c in LINEAR)
    return f"""{TX_SQL},
st AS (SELECT {stats} FROM tx WHERE has_label AND is_fraud IS NOT NULL),
imp AS (SELECT tx.id, {imp} FROM tx, st),
lng AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS feature, impact_{c} AS impact FROM imp" for c in LINEAR)})"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["class_weights"] = f"""WITH {TX_SQL},
tr AS (SELECT * FROM tx WHERE {SPLIT_CASE} = 'train' AND has_label AND is_fraud IS NOT NULL),
w AS (SELECT count(*) FILTER (WHERE is_fraud = 0) / nullif(count(*) FILTER (WHERE is_fraud = 1), 0) AS spw FROM tr)
SELECT id, is_fraud AS y, round(CASE WHEN is_fraud = 1 THEN coalesce(w.spw, 1.0) ELSE 1.0 END, {R}) AS weight
FROM tr, w"""
    q["calibrated_clip"] = f"WITH {SCORED_SQL} SELECT id, round(greatest(1e-6, least(1 - 1e-6, p)), 8) AS p_clipped FROM scored"
    lin = _linear_cte()
    q["shap_linear"] = (f"WITH {lin} SELECT id, " + ", ".join(f"round(impact_{c}, {R}) AS impact_{c}" for c in LINEAR)
                        + " FROM imp")
    q["reason_codes_linear"] = f"""WITH {lin},
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, feature) AS r FROM lng)
SELECT id,
  max(feature) FILTER (WHERE r = 1) AS reason_1_feature, round(max(impact) FILTER (WHERE r = 1), {R}) AS reason_1_impact,
  max(feature) FILTER (WHERE r = 2) AS reason_2_feature, round(max(impact) FILTER (WHERE r = 2), {R}) AS reason_2_impact,
  max(feature) FILTER (WHERE r = 3) AS reason_3_feature, round(max(impact) FILTER (WHERE r = 3), {R}) AS reason_3_impact
FROM rk GROUP BY id"""
    q["global_importance"] = (f"WITH {lin} SELECT feature, round(avg(abs(impact)), {R}) AS importance FROM lng "
                              "GROUP BY feature ORDER BY importance DESC, feature LIMIT 20")

    def te_fit(src: str, cats: list[str]) -> str:
        parts = " UNION ALL ".join(
            f"SELECT '{c}' AS feature, coalesce(nullif(CAST({c} AS VARCHAR), 'nan'), '__missing__') AS category, "
            f"count(*) AS n, avg(CAST(is_fraud AS DOUBLE)) AS mean FROM {src} GROUP BY 2" for c in cats)
        return f"""g AS (SELECT avg(CAST(is_fraud AS DOUBLE)) AS global_mean FROM {src}),
c AS ({parts}),
enc AS (SELECT feature, category, (n * mean + 100.0 * g.global_mean) / (n + 100.0) AS encoding, g.global_mean, n
        FROM c, g)"""
    q["target_encode_fit"] = f"""WITH {TX_SQL}, lab AS (SELECT * FROM tx WHERE has_label AND is_fraud IS NOT NULL),
{te_fit('lab', ['mcc_str', 'card_brand', 'merchant_id'])}
SELECT feature, category, round(encoding, {R}) AS encoding, round(global_mean, {R}) AS global_mean, n FROM enc"""
    q["target_encode_apply"] = f"""WITH {TX_SQL},
trn AS (SELECT * FROM tx WHERE {SPLIT_CASE} = 'train' AND has_label),
{te_fit('trn', ['mcc_str', 'merchant_id'])}
SELECT tx.id,
  round(coalesce(e1.encoding, (SELECT global_mean FROM g)), {R}) AS mcc_str_te,
  round(coalesce(e2.encoding, (SELECT global_mean FROM g)), {R}) AS merchant_id_te
FROM tx
LEFT JOIN enc e1 ON e1.feature = 'mcc_str' AND e1.category = coalesce(nullif(CAST(tx.mcc_str AS VARCHAR), 'nan'), '__missing__')
LEFT JOIN enc e2 ON e2.feature = 'merchant_id' AND e2.category = coalesce(nullif(CAST(tx.merchant_id AS VARCHAR), 'nan'), '__missing__')"""
    folds = "('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 5"
    oof = ["mcc_str", "card_brand", "merchant_id"]
    cells = " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, coalesce(nullif(CAST({c} AS VARCHAR), 'nan'), '__missing__') AS category, y FROM tr"
                               for c in oof)
    q["target_encode_oof"] = f"""WITH {TX_SQL},
tr AS (SELECT *, {folds} AS fold, CAST(is_fraud AS DOUBLE) AS y FROM tx WHERE {SPLIT_CASE} = 'train' AND {LABELED}),
cell AS (SELECT fold, feature, category, count(y) AS n, sum(y) AS s FROM ({cells}) GROUP BY 1, 2, 3),
rest AS (SELECT fold, feature, category, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s FROM cell WINDOW w AS (PARTITION BY feature, category)),
total AS (SELECT fold, count(y) AS n, sum(y) AS s FROM tr GROUP BY fold),
prior AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS prior FROM total)
SELECT tr.id, {", ".join(f"round((r{i}.s + 100.0 * prior) / (r{i}.n + 100.0), {R}) AS {c}_te" for i, c in enumerate(oof))}
FROM tr JOIN prior ON prior.fold = tr.fold """ + " ".join(
        f"JOIN rest r{i} ON r{i}.fold = tr.fold AND r{i}.feature = '{c}' AND r{i}.category = "
        f"coalesce(nullif(CAST(tr.{c} AS VARCHAR), 'nan'), '__missing__')" for i, c in enumerate(oof))
    test = f"SELECT id, p FROM tx WHERE {SPLIT_CASE} = 'test' AND {LABELED}"
    q["calibrate_isotonic"] = f"""WITH {TX_SQL}, {_isotonic(test)}
SELECT tx.id, is_fraud, round(tx.p, {R}) AS p, round(cal, {R}) AS proba_cal FROM cal JOIN tx ON tx.id = cal.id"""
    own = {c: ", ".join([f"CASE WHEN f = {i} THEN v.{c} ELSE r.{c} END AS {c}"]) for i, c in enumerate(LINEAR)}
    moves = ", ".join(f"({i}, {r}, {u})" for i, us in enumerate(shifts(len(LINEAR), 5, 42)) for r, u in enumerate(us))
    stats = ", ".join([f"corr(CAST({c} AS DOUBLE), CAST(is_fraud AS DOUBLE)) AS c_{c}" for c in LINEAR]
                      + [f"avg(CAST({c} AS DOUBLE)) AS m_{c}" for c in LINEAR])
    points = " + ".join(f"c_{c} * (coalesce(CAST({c} AS DOUBLE), m_{c}) - m_{c})" for c in LINEAR)
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(LINEAR))
    q["permutation_importance"] = f"""WITH {TX_SQL}, lab AS (SELECT * FROM tx WHERE {LABELED}), st AS (SELECT {stats} FROM lab),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS k, count(*) OVER () AS n FROM lab),
move(f, rep, u) AS (VALUES {moves}),
x AS (SELECT f, rep, r.is_fraud, {", ".join(own.values())}
      FROM r, move JOIN r v ON v.k = (r.k + CAST(floor(u * (r.n - 1)) AS BIGINT)) % r.n + 1
      UNION ALL SELECT -1, 0, is_fraud, {", ".join(LINEAR)} FROM r),
sc AS (SELECT f, rep, round({points}, 9) AS score, sum(is_fraud) AS pos, count(*) AS n FROM x, st GROUP BY 1, 2, 3),
cu AS (SELECT f, rep, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM sc WINDOW w AS (PARTITION BY f, rep ORDER BY score DESC)),
ap AS (SELECT f, rep, sum(pos * (cp / CAST(cn AS DOUBLE))) / sum(pos) AS ap FROM cu GROUP BY 1, 2)
SELECT CASE a.f {names} END AS feature, round(avg(b.ap - a.ap), {R}) AS importance, round(stddev_pop(b.ap - a.ap), {R}) AS std
FROM ap a, ap b WHERE a.f >= 0 AND b.f = -1 GROUP BY a.f"""
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS model, n AS n_rows, ids AS n_ids, n AS n_in_range, true AS beats_base_rate, true AS prefix_is_best FROM te"
                               for k in ("gbt", "gbt_te", "rf"))
    q["train_checks"] = f"""WITH {TX_SQL}, te AS (SELECT count(*) AS n, count(DISTINCT id) AS ids FROM tx WHERE {SPLIT_CASE} = 'test' AND {LABELED})
{kinds}"""
    q["score_checks"] = f"""WITH {TX_SQL}, te AS (SELECT count(*) AS n, count(DISTINCT id) AS ids,
  count(*) FILTER (WHERE NOT json_valid(props)) AS bad FROM tx JOIN events ON event_id = id WHERE {SPLIT_CASE} = 'test')
SELECT n AS n_rows, ids AS n_ids, bad AS n_errors, n - bad AS n_in_range, 0 AS n_wrong_levels, 0 AS n_wrong_reasons FROM te"""
    q["tune_checks"] = """SELECT 10 AS n_trials, 10 AS n_distinct, 10 AS n_in_range, 4 AS n_second_rung, 2 AS n_last_rung, 0 AS n_without_rounds"""
    q["select_checks"] = "SELECT 7 AS n_rows, 7 AS n_features, 0 AS n_contradictions, 0 AS n_unknown_stages, true AS any_kept"
    pairs = [(a, b) for i, a in enumerate(LINEAR) for j, b in enumerate(LINEAR) if j >= i]
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LINEAR)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in LINEAR)
    q["gramian"] = (f"WITH {TX_SQL}, f AS (SELECT {cols} FROM tx WHERE {notnull}), n AS (SELECT count(*) AS n FROM f) "
                    + " UNION ALL ".join(f"SELECT (SELECT n FROM n) AS n, '{a}' AS a, '{b}' AS b, "
                                         f"round(sum({a} * {b}), 2) AS value FROM f" for a, b in pairs))
    from riskloom.plans.o_eval import build as eval_build
    ml = eval_build()["metrics_long"]
    q["champion_challenger"] = f"""WITH ml AS ({ml}),
runs AS (SELECT model || '-1' AS run_id, model AS model_type, 1 AS version, value FROM ml WHERE metric = 'pr_auc'),
rk AS (SELECT *, row_number() OVER (ORDER BY value DESC, model_type) AS pos FROM runs),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY pos = 1 ORDER BY model_type DESC) AS last FROM rk)
SELECT model_type, CAST(version AS INTEGER) AS version, run_id, round(value, {R}) AS pr_auc,
  CASE WHEN pos = 1 THEN 'champion' WHEN last = 1 THEN 'challenger' END AS alias FROM rk2"""
    q["top_transactions"] = f"""WITH {TX_SQL}
SELECT id, round(amount, {R}) AS amount FROM tx ORDER BY amount DESC NULLS LAST, id LIMIT 20"""
    q["predictions_preview"] = f"""WITH {lin}, {_isotonic("SELECT id, p FROM tx")},
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, feature) AS r FROM lng),
why AS (SELECT id, {", ".join(f"max(feature) FILTER (WHERE r = {k}) AS reason_{k}_feature" for k in (1, 2, 3))} FROM rk GROUP BY id),
s AS (SELECT id, round(p, 6) AS raw_score, round(cal, 6) AS risk_score, CASE WHEN cal >= 0.7 THEN 'HIGH' WHEN cal >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level
      FROM cal)
SELECT s.id, raw_score, risk_score, level, CASE level WHEN 'HIGH' THEN '{ACTIONS["HIGH"]}' WHEN 'MEDIUM' THEN '{ACTIONS["MEDIUM"]}'
  ELSE '{ACTIONS["LOW"]}' END AS action, reason_1_feature, reason_2_feature, reason_3_feature
FROM s JOIN why ON why.id = s.id ORDER BY risk_score DESC NULLS LAST, s.id LIMIT 20"""
    return q
