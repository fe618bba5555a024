"""Past-only windows against a brute-force Python reference (ties, edges, buckets, leakage)."""

import random
from datetime import datetime, timedelta

import pytest

from riskloom.operators import risk, windows

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, date timestamp, card_id long, client_id long, amount double, merchant_id long, mcc_str string, is_fraud int, has_label boolean, card_brand string"


def make_rows(n=400, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ent = rng.choice([1, 2, 3, 4, 5])
        t = T0 + timedelta(seconds=rng.choice([0, 0, 30, 600, 3600]) * rng.randint(0, 400))
        amt = None if rng.random() < 0.03 else round(rng.uniform(-20, 300), 2)
        merch = None if rng.random() < 0.05 else rng.randint(1, 6)
        lab = rng.random() < 0.7
        rows.append((i, t, ent, ent % 2, amt, merch, rng.choice(["a", "b", "c"]),
                     (1 if rng.random() < 0.2 else 0) if lab else None, lab, ["Visa", "MC"][ent % 2]))
    # exactly-w-before edge and a single-row entity
    rows.append((10_000, T0 + timedelta(hours=5), 9, 9, 10.0, 1, "a", 0, True, "Visa"))
    rows.append((10_001, T0 + timedelta(hours=6), 9, 9, 20.0, 2, "b", 1, True, "Visa"))
    rows.append((10_002, T0 + timedelta(days=3), 42, 42, 5.0, 1, "a", 0, True, "Visa"))
    return rows


def brute(rows, ent_idx, w_sec, ties=True):
    out = {}
    for r in rows:
        past = [q for q in rows if q[ent_idx] == r[ent_idx] and
                (q[1] < r[1] or (ties and q[1] == r[1] and q[0] < r[0])) and q[1] >= r[1] - timedelta(seconds=w_sec)]
        amts = [q[4] for q in past if q[4] is not None]
        out[r[0]] = (len(past), sum(amts), (sum(amts) / len(amts)) if amts else None, max(amts) if amts else None,
                     len({q[5] for q in past if q[5] is not None}), len({q[6] for q in past}))
    return out


@pytest.mark.parametrize("ties,factor", [("row_order", 4), ("row_order", 1), ("strict", 1)])
def test_velocity_matches_brute_force(spark, ties, factor):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    wins = {"10m": 600, "1h": 3600}
    out = windows.add_velocity(df, "card_id", "card", windows=wins, ties=ties, bucket_factor=factor).collect()
    for label, sec in wins.items():
        exp = brute(rows, 2, sec, ties == "row_order")
        for r in out:
            e = exp[r.id]
            got = (r[f"card_tx_count_{label}"], r[f"card_amount_sum_{label}"], r[f"card_amount_mean_{label}"],
                   r[f"card_amount_max_{label}"], r[f"card_unique_merchants_{label}"], r[f"card_unique_mcc_{label}"])
            assert got[0] == e[0] and got[4] == e[4] and got[5] == e[5], (r.id, got, e)
            assert got[1] == pytest.approx(e[1], abs=1e-6)
            assert (got[2] is None) == (e[2] is None) and (e[2] is None or got[2] == pytest.approx(e[2]))
            assert got[3] == e[3]


def test_left_edge_inclusive_and_empty_past(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    out = {r.id: r for r in windows.add_velocity(df, "card_id", "card", windows={"1h": 3600}).collect()}
    assert out[10_001].card_tx_count_1h == 1  # the row exactly 1h before counts
    assert out[10_002].card_tx_count_1h == 0 and out[10_002].card_amount_sum_1h == 0.0
    assert out[10_002].card_amount_mean_1h is None and out[10_002].card_amount_max_1h is None


def test_z_score_brute(spark):
    import statistics
    rows = make_rows(200, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.id: r.z_score_amount for r in windows.add_z_score_amount(df, entity_col="card_id").collect()}
    for r in rows:
        past = [q[4] for q in rows if q[2] == r[2] and (q[1] < r[1] or (q[1] == r[1] and q[0] < r[0]))
                and q[1] >= r[1] - timedelta(days=7) and q[4] is not None]
        if not past or r[4] is None:
            assert out[r[0]] is None
            continue
        sd = statistics.stdev(past) if len(past) >= 2 else 0.0
        exp = (r[4] - statistics.fmean(past)) / (sd + 1e-6)
        assert out[r[0]] == pytest.approx(exp, rel=1e-6, abs=1e-6)


def test_recency_and_novelty(spark):
    rows = make_rows(150, seed=11)
    df = spark.createDataFrame(rows, SCHEMA)
    rec = {r.id: r.time_since_last_tx_card for r in windows.add_time_since_last_tx(df, bucket_us=3_600_000_000).collect()}
    nov = {r.id: r for r in windows.add_novelty(df).collect()}
    order = sorted(rows, key=lambda q: (q[2], q[1], q[0]))
    prev = {}
    seen = set()
    for q in order:
        p = prev.get(q[2])
        exp = None if p is None else (q[1] - p).total_seconds()
        assert rec[q[0]] == exp
        prev[q[2]] = q[1]
        key = (q[2], q[5])
        first = int(q[5] is not None and key not in seen)
        if q[5] is not None:
            seen.add(key)
        assert nov[q[0]].first_time_merchant_card == first


def test_no_leakage_from_future_rows(spark):
    rows = make_rows(200, seed=5)
    cut = T0 + timedelta(hours=40)
    changed = [(r[0], r[1], r[2], r[3], float((r[4] or 0) * 7 + 1), 99, "z", r[7], r[8], r[9]) if r[1] > cut else r
               for r in rows]
    a = {r.id: r for r in windows.add_behavioral_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    b = {r.id: r for r in windows.add_behavioral_features(spark.createDataFrame(changed, SCHEMA)).collect()}
    cols = [c for c in windows.add_behavioral_features(spark.createDataFrame(rows[:3], SCHEMA)).columns
            if c.startswith(("card_", "user_", "time_since", "z_score")) and c not in ("card_id", "card_brand")]
    for r in rows:
        if r[1] <= cut:
            for c in cols:
                assert a[r[0]][c] == b[r[0]][c], (r[0], c)


def test_risk_rate_brute_and_buckets(spark):
    rows = make_rows(300, seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (3_600_000_000, 86_400_000_000):
        out = {r.id: r.card_brand_historical_fraud_rate
               for r in risk.add_card_brand_fraud_rate(df, bucket_us=bucket).collect()}
        order = sorted(rows, key=lambda q: (q[9], q[1], q[0]))
        acc = {}
        for q in order:
            lab, fr = acc.get(q[9], (0, 0))
            assert out[q[0]] == pytest.approx((fr + 1.0) / (lab + 10.0))
            if q[8]:
                acc[q[9]] = (lab + 1, fr + (q[7] or 0))


def test_no_sliding_frame_and_null_entities(spark):
    rows = [r if r[0] % 3 else r[:2] + (None,) + r[3:] for r in make_rows(300, seed=21)]
    rows += [(20_000 + i, None, 1, 1, 5.0, 1, "a", 0, True, "Visa") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    q = windows.add_velocity(df, "card_id", "card", windows={"10m": 600, "1h": 3600})
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "-600000000" not in plan and "collect_set" not in plan
    out = {r.id: r for r in q.collect()}
    assert len(out) == len(rows)
    live = [r for r in rows if r[2] is not None and r[1] is not None]
    exp = brute(live, 2, 3600)
    for r in rows:
        o = out[r[0]]
        got = (o.card_tx_count_1h, o.card_amount_max_1h, o.card_unique_merchants_1h)
        assert got == ((exp[r[0]][0], exp[r[0]][3], exp[r[0]][4]) if r[0] in exp else (0, None, 0))


@pytest.mark.parametrize("ties", ["row_order", "strict"])
@pytest.mark.parametrize("block", [3600, 5400, 1800])
def test_hot_entities_by_blocks_match_brute_force(spark, ties, block):
    import statistics
    rows = make_rows(500, seed=31)
    df = spark.createDataFrame(rows, SCHEMA)
    wins = {"10m": 600, "1h": 3600, "1d": 86400, "2d": 172_800}
    out = windows.add_velocity(df, "card_id", "card", windows=wins, ties=ties, z_window="2d", recency=True, hot_rows=5,
                               hot_block=block).collect()
    assert len(out) == len(rows)
    plain = {r.id: r for r in windows.add_velocity(df, "card_id", "card", windows=wins, ties=ties, z_window="2d", recency=True,
                                                   hot_rows=None).collect()}
    by_id = {r[0]: r for r in rows}
    for label, sec in wins.items():
        exp = brute(rows, 2, sec, ties == "row_order")
        for r in out:
            e = exp[r.id]
            got = (r[f"card_tx_count_{label}"], r[f"card_amount_sum_{label}"], r[f"card_amount_mean_{label}"],
                   r[f"card_amount_max_{label}"], r[f"card_unique_merchants_{label}"], r[f"card_unique_mcc_{label}"])
            assert (got[0], got[3], got[4], got[5]) == (e[0], e[3], e[4], e[5]), (label, r.id, got, e)
            assert got[1] == pytest.approx(e[1], abs=1e-6)
            assert (got[2] is None) == (e[2] is None) and (e[2] is None or got[2] == pytest.approx(e[2]))
    for r in out:
        t = by_id[r.id]
        assert r.time_since_last_tx_card == plain[r.id].time_since_last_tx_card
        past = [q[4] for q in rows if q[2] == t[2] and (q[1] < t[1] or (ties == "row_order" and q[1] == t[1] and q[0] < t[0]))
                and q[1] >= t[1] - timedelta(days=2) and q[4] is not None]
        if not past or t[4] is None:
            assert r.z_score_amount is None
        else:
            sd = statistics.stdev(past) if len(past) > 1 else 0.0
            assert r.z_score_amount == pytest.approx((t[4] - statistics.fmean(past)) / (sd + 1e-6), rel=1e-6, abs=1e-6)


def test_non_finite_amounts(spark):
    odd = {3: float("nan"), 11: float("inf"), 12: float("-inf")}
    rows = [r[:4] + (odd.get(r[0], r[4]),) + r[5:] for r in make_rows(60, seed=2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (None, 3):
        for r in windows.add_velocity(df, "card_id", "card", windows={"w": 86_400 * 30}, hot_rows=hot).collect():
            t = next(q for q in rows if q[0] == r.id)
            past = [q[4] for q in rows if q[2] == t[2] and (q[1], q[0]) < (t[1], t[0]) and q[4] is not None]
            total = sum(past)
            assert r.card_amount_sum_w == pytest.approx(total, abs=1e-6, nan_ok=True)
            if past:
                most = float("nan") if any(x != x for x in past) else max(past)
                assert r.card_amount_max_w == pytest.approx(most, nan_ok=True)


def test_rows_of_one_entity_are_spread_over_blocks(spark):
    """Ten times the rows of one entity: more segments or rows in them, but the same number of rows for each hour."""
    from riskloom.operators import window_kernel as K
    seen = []
    for n in (2_000, 20_000):
        df = spark.range(n).selectExpr("id", f"timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60) as date",
                                       "1L as card_id", "1.0D as amount", "id % 7 as merchant_id", "'a' as mcc_str")
        out = windows.add_velocity(df, "card_id", "card", windows={"1h": 3600, "7d": 604_800}, hot_rows=100, hot_block="1h")
        r = out.agg({"card_tx_count_7d": "max", "card_unique_merchants_7d": "max", "card_tx_count_1h": "max"}).first().asDict()
        assert r["max(card_tx_count_7d)"] == min(n - 1, 10_080) and r["max(card_unique_merchants_7d)"] == 7
        assert r["max(card_tx_count_1h)"] == 60
        seen.append(len(K.offsets(604_800, 3600)))
    assert seen == [1, 1]                            # a block takes its own rows and those of one other for this window


def test_one_sort_of_narrow_rows(spark):
    df = spark.createDataFrame(make_rows(50), SCHEMA)
    plan = windows.add_velocity(df, "card_id", "card")._jdf.queryExecution().executedPlan().toString()
    narrow = plan[plan.index("MapInArrow"):]
    narrow = narrow[:narrow.index("Scan ")]
    assert narrow.count("Sort [") == 1 and "card_brand" not in narrow and " Window " not in plan
