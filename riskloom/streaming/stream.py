"""Structured Streaming path.

T1 stream scan + watermark, T2 stream-static enrichment, T3 per-card
past-only rolling count/sum kept in ``applyInPandasWithState``: a row waits in
the state until the watermark has passed it, so rows may arrive in any order
within the watermark and the results equal the batch operator's; state is
evicted by the watermark, and rows behind it are dropped and counted.  T4
scoring through ``foreachBatch``, one folder an epoch, so a replayed epoch
replaces itself, and windowed alert counts.
Checkpoints go under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from riskloom.functions.timecols import epoch_us
from riskloom.operators.gold import broadcast_if_small
from riskloom.operators.score import level_of
from riskloom.plans.views import tx_from_events
from riskloom.session import checkpoint_dir

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_transactions(spark: SparkSession, path: str, watermark: str = "1 hour",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Events folder as a stream, mapped to the transaction view, with a
    watermark on the event time."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    t = tx_from_events(r.parquet(path))
    return t.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", watermark)


def enrich(stream: DataFrame, dim: DataFrame, stream_key: str, dim_key: str) -> DataFrame:
    """Stream-static left join; the dimension is broadcast only when its
    estimated size is within the bound."""
    d = dim.withColumnRenamed(dim_key, "__dk")
    return stream.join(broadcast_if_small(d), F.col(stream_key) == F.col("__dk"), "left").drop("__dk")


OUT_SCHEMA = "id long, card_id long, past_count long, past_sum double"
STATE_SCHEMA = "us array<long>, ids array<long>, amounts array<double>, done long"


def rolling_past(us: np.ndarray, amounts: np.ndarray, w_us: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) over the past window of each wanted row of arrays in (instant, id) order."""
    at = np.flatnonzero(wanted)
    lo = np.searchsorted(us, us[at] - w_us)
    total = np.concatenate(([0.0], np.cumsum(np.nan_to_num(amounts))))
    return at - lo, np.where(at > lo, total[at] - total[lo], 0.0)


def _rolling_fn(w_us: int):
    def fn(key, pdfs, state):
        us, ids, amounts, done = state.get if state.exists else ([], [], [], -(1 << 62))
        parts = [] if state.hasTimedOut else list(pdfs)
        us = np.concatenate([np.asarray(us, "int64"), *[p["__us"].to_numpy("int64") for p in parts]])
        ids = np.concatenate([np.asarray(ids, "int64"), *[p["id"].to_numpy("int64") for p in parts]])
        amounts = np.concatenate([np.asarray(amounts, "float64"), *[p["amount"].to_numpy("float64") for p in parts]])
        order = np.lexsort((ids, us))
        us, ids, amounts = us[order], ids[order], amounts[order]
        # No row before the watermark can come any more: what lies there is final.
        mark = state.getCurrentWatermarkMs() * 1000
        ready = (us >= done) & (us < mark)
        count, total = rolling_past(us, amounts, w_us, ready)
        out = pd.DataFrame({"id": ids[ready], "card_id": np.full(len(count), key[0]), "past_count": count, "past_sum": total})
        done = max(done, mark)
        keep = us >= done - w_us
        us, ids, amounts = us[keep], ids[keep], amounts[keep]
        if len(us):
            state.update((us.tolist(), ids.tolist(), amounts.tolist(), int(done)))
            waiting = us[us >= done]
            wake = waiting[0] if len(waiting) else us[-1] + w_us
            state.setTimeoutTimestamp(max(int(wake // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield out
    return fn


def rolling_card_state(stream: DataFrame, window_s: int = 3600) -> DataFrame:
    """Per-card past-only count and sum over ``window_s`` (row-order ties,
    like the batch operator), given out when the watermark has passed a row.
    Rows behind the watermark are dropped by Spark; ``late_rows`` counts them."""
    s = stream.select("id", "card_id", "amount", epoch_us("date").alias("__us"), "date")
    return s.groupBy("card_id").applyInPandasWithState(
        _rolling_fn(window_s * 1_000_000), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query) -> int:
    """Rows that the state operators of a running or stopped query dropped behind the watermark, as far as its progress
    reports reach back."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in (p if isinstance(p, dict) else p.jsonValue)["stateOperators"])


def alert_counts_by_window(scored_stream: DataFrame, p_col: str = "p", window: str = "1 hour") -> DataFrame:
    """T4: HIGH/MEDIUM/LOW counts per event-time window (append after the watermark)."""
    return scored_stream.withColumn("level", level_of(F.col(p_col))) \
        .groupBy(F.window("date", window).alias("w"), "level").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "level", "n")


def epoch_writer(score_fn, out_path: str):
    """The ``foreachBatch`` function that scores a micro-batch into the folder of its epoch.

    An epoch that is replayed after a failure overwrites its own folder, so every
    row is there once; readers see ``epoch`` as a partition column.
    """
    def each(batch: DataFrame, epoch_id: int) -> None:
        score_fn(batch).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}")
    return each


def start_scoring_sink(stream: DataFrame, score_fn, out_path: str, name: str = "score"):
    """T4: every micro-batch goes through the same batch ``score_fn`` into
    ``out_path``; the checkpoint makes the sink restartable."""
    ck = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name}"
    return stream.writeStream.foreachBatch(epoch_writer(score_fn, out_path)).option("checkpointLocation", ck).start()
