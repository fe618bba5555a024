import json
import tempfile

import pytest

from pyspark.sql import functions as F

from riskloom.operators import windows
from riskloom.plans import views as V
from riskloom.sources import raw, sinks
from riskloom.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def test_raw_sources(spark):
    d = tempfile.mkdtemp(prefix="riskloom-src-")
    with open(f"{d}/tx.csv", "w") as f:
        f.write("id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors\n")
        f.write('1,2010-01-01 00:01:00,10,100,$-77.00,Swipe,5,"Monroe, X",NY,1234.0,5411,\n')
        f.write("2,not-a-date,10,100,$14.57,Chip,6,Y,CA,,5912,Bad PIN\n")
    t = raw.load_transactions(spark, f"{d}/tx.csv").collect()
    assert t[0].date is not None and t[1].date is None and t[0].merchant_city == "Monroe, X"
    with open(f"{d}/mcc.json", "w") as f:
        json.dump({"root": {"5411": "Grocery", "5912": "Drug"}}, f)
    assert {r.mcc_str: r.mcc_description for r in raw.load_mcc_codes(spark, f"{d}/mcc.json").collect()} == \
        {"5411": "Grocery", "5912": "Drug"}
    with open(f"{d}/labels.json", "w") as f:
        json.dump({"target": {str(i): ("Yes" if i % 7 == 0 else "No") for i in range(5000)}}, f)
    lab = raw.load_fraud_labels(spark, f"{d}/labels.json")
    assert lab.count() == 5000 and lab.where("is_fraud = 1").count() == len(range(0, 5000, 7))


def test_gold_write(spark):
    d = tempfile.mkdtemp(prefix="riskloom-sink-")
    t = V.tx(spark, SF)
    sinks.write_gold(t, f"{d}/gold2")
    assert sinks.read_gold(spark, f"{d}/gold2", labeled_only=True).count() == t.where("has_label").count()


def test_publish_is_atomic_and_keeps_versions(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/t"
    with pytest.raises(ValueError):
        sinks.read_published(spark, target)
    assert sinks.publish(spark.range(3), target) == 3
    # Rows that are not what was expected are never published.
    with pytest.raises(ValueError):
        sinks.publish(spark.range(4), target, expected_rows=5)
    assert sinks.read_published(spark, target).count() == 3
    # A crash between the write and the pointer: readers, and a retry, see the old version.
    real, calls = sinks._pointer, []

    def crash(*a, **k):
        calls.append(a)
        raise RuntimeError("lost")
    monkeypatch.setattr(sinks, "_pointer", crash)
    with pytest.raises(RuntimeError):
        sinks.publish(spark.range(7), target)
    monkeypatch.setattr(sinks, "_pointer", real)
    assert calls and sinks.read_published(spark, target).count() == 3
    assert sinks.publish(spark.range(7), target, expected_rows=7) == 7
    assert sinks.read_published(spark, target).count() == 7 and sinks.read_published(spark, target, back=1).count() == 3


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "cards.csv").write_text(",".join(raw.CARDS_SCHEMA.names) + "\n1,7,Visa,Debit,4344,12/2022,623,YES,2,\"$1,200\",09/2002,2008,No\n")
    (tmp_path / "users.csv").write_text(",".join(raw.USERS_SCHEMA.names) + "\n7,53,66,1966,11,F,\"462 Rose, Lane\",34.1,-117.7,$20,$50,$-3,787,5\n")
    (tmp_path / "flat.json").write_text(json.dumps({"5411": "Grocery"}))
    c, u = raw.load_cards(spark, f"{tmp_path}/cards.csv").first(), raw.load_users(spark, f"{tmp_path}/users.csv").first()
    assert c.id == 1 and c.credit_limit == "$1,200" and u.id == 7 and u.total_debt == "$-3"
    assert [tuple(r) for r in raw.load_mcc_codes(spark, f"{tmp_path}/flat.json").collect()] == [("5411", "Grocery")]
    m = spark.createDataFrame([("a", "pr_auc", 0.5)], "model string, metric string, value double")
    for _ in range(2):
        sinks.write_metrics(m, f"{tmp_path}/metrics")
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == 2
    p = spark.createDataFrame([(1, 0.25, "LOW", "amount", 1.5, "3,0", None), (2, None, None, None, None, None, "malformed payload")],
                              "id long, risk_score double, level string, reason_1_feature string, reason_1_impact double, "
                              "reason_1_value string, error string")
    sinks.write_predictions_csv(p, f"{tmp_path}/csv", top_k=1)
    assert sorted(map(tuple, sinks.read_predictions_csv(spark, f"{tmp_path}/csv", top_k=1).select(*p.columns).collect())) == \
        sorted(map(tuple, p.collect()))


def test_stream_state_equals_batch_on_shuffled_files(spark):
    """Rows come up to a day out of order; one row far behind the watermark is dropped and counted."""
    d = tempfile.mkdtemp(prefix="riskloom-stream-")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cuts = ["2024-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "2024-02-01"]
    moved = ev.withColumn("file", F.col("ts") + F.expr("make_dt_interval(0, pmod(hash(event_id), 24))"))
    last = ev.selectExpr("event_id + 10000000 AS event_id", "timestamp_ntz'2024-03-01' AS ts", "-5L AS user_id", "event_type", "value", "props").limit(1)
    late = ev.selectExpr("event_id + 20000000 AS event_id", "timestamp_ntz'2024-01-02' AS ts", "user_id", "event_type", "value", "props").limit(1)
    for k, (lo, hi) in enumerate(zip(["2000-01-01", *cuts[1:4]], [*cuts[1:4], "2100-01-01"])):
        moved.where((F.col("file") >= lo) & (F.col("file") < hi)).drop("file").coalesce(1).write.parquet(f"{d}/in{k}")
    last.coalesce(1).write.parquet(f"{d}/in4")
    late.coalesce(1).write.parquet(f"{d}/in5")
    spark.createDataFrame([], ev.schema).write.parquet(f"{d}/events")
    s = ST.stream_transactions(spark, f"{d}/events", watermark="2 days", max_files_per_trigger=1)
    q = ST.rolling_card_state(s, 3600).writeStream.format("memory").queryName("rolling_out").outputMode("append").start()
    for k in range(6):                               # one file after the other
        spark.read.schema(ev.schema).parquet(f"{d}/in{k}").coalesce(1).write.mode("append").parquet(f"{d}/events")
        q.processAllAvailable()
    late_count = ST.late_rows(q)
    q.stop()
    rows = spark.table("rolling_out").collect()
    got = {r.id: (r.past_count, r.past_sum) for r in rows}
    exp = {r.id: (r.card_tx_count_1h, r.card_amount_sum_1h)
           for r in windows.add_velocity(V.tx(spark, SF), "card_id", "card", windows={"1h": 3600}).collect()}
    assert len(rows) == len(got) and set(got) == set(exp) and late_count == 1
    for k, (c, s_) in exp.items():
        assert got[k][0] == c and abs(got[k][1] - s_) < 1e-6


def test_scoring_sink_replaces_a_replayed_epoch(spark, tmp_path):
    from riskloom.operators.score import risk_level
    t = V.tx(spark, SF).select("id", "p")
    write = ST.epoch_writer(lambda b: risk_level(b, "p").select("id", "risk_score", "level"), f"{tmp_path}/out")
    a, b = t.where("id % 2 = 0"), t.where("id % 2 = 1")
    for batch, epoch in ((a, 0), (b, 1), (b, 1), (a, 0)):
        write(batch, epoch)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("id").distinct().count() == t.count() and out.where("epoch = 0").count() == a.count()


def test_enrich_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events")
    dim = spark.createDataFrame([("Visa", "v"), ("Amex", "a")], "brand string, short string")
    s = ST.enrich(ST.stream_transactions(spark, f"{tmp_path}/events"), dim, "card_brand", "brand")
    q = s.select("id", "card_brand", "short").writeStream.format("memory").queryName("enriched").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.card_brand, r.short) for r in spark.table("enriched").collect()}
    assert got == {("Visa", "v"), ("Amex", "a"), ("Mastercard", None), ("Other", None)}


def test_alert_counts_stream(spark):
    d = tempfile.mkdtemp(prefix="riskloom-stream2-")
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{d}/events")
    s = ST.stream_transactions(spark, f"{d}/events", watermark="1 hour")
    q = ST.alert_counts_by_window(s).writeStream.format("memory").queryName("alerts_out") \
        .outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    total = spark.table("alerts_out").agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{SF}/events.parquet").count()


def test_splits_keep_all_rows(spark, tmp_path):
    from riskloom.config import SplitBoundaries
    from riskloom.operators.splits import save_splits
    df = spark.sql("SELECT id, timestamp'2024-01-18' + make_dt_interval(id) AS date FROM range(10)")
    b = SplitBoundaries(train_end="2024-01-20", val_end="2024-01-23", test_start="2024-01-25")
    out = spark.read.parquet(save_splits(df, f"{tmp_path}/splits", b))
    assert out.count() == 10 and out.where("split = 'unassigned'").count() == 1
