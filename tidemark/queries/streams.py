"""Streaming queries, run to the end of the data; results are compared as batches."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.queries.batch import SLIDING_WINDOW
from tidemark.queries.common import EVENT_TXNS, at, events, exact, plain
from tidemark.session import apply_settings, work_folder
from tidemark.sources.feature_table import FeatureTable
from tidemark.sources.latest_table import LatestTable
from tidemark.sources.streams import event_stream
from tidemark.streaming.sinks import (
    SINK_TTL,
    VELOCITY_FEATURES,
    VELOCITY_TTL,
    as_feature_rows,
    dual_write,
)
from tidemark.streaming.keyed import keyed_sliding_stream
from tidemark.streaming.side_outputs import side_outputs, side_totals
from tidemark.streaming.sliding import sliding_stream
from tidemark.streaming.velocity import (
    LateRows,
    append_to_folder,
    hop_velocity,
    streaming_session,
)

HOPS = f"""{EVENT_TXNS}, hops AS (
  SELECT user_id, count(*) AS txn_count_5m, {exact('amount')} AS txn_amount_sum_5m,
         count(*) / 5.0::DOUBLE AS velocity_per_min, window_end
  FROM (SELECT *, date_trunc('minute', event_ts) + to_minutes(i) AS window_end
        FROM events_t, range(1, 6) t(i))
  GROUP BY user_id, window_end),
closed AS (SELECT * FROM hops
  WHERE window_end <= (SELECT max(ts) - INTERVAL 10 SECONDS FROM events))"""


def _streamed(spark: SparkSession, folder: str, **windows):
    root, session = work_folder(spark, "hops"), streaming_session(apply_settings(spark))
    stream = hop_velocity(event_stream(session, folder), **windows)
    append_to_folder(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").withColumn("window_end", plain("window_end"))


def hop_velocity_stream(spark, folder):
    return _streamed(spark, folder)


HOP_VELOCITY_STREAM = f"WITH {HOPS} SELECT * FROM closed"


def hop_velocity_batch(spark, folder):
    """The same windows over the table at once: nothing is left open."""
    return hop_velocity(events(spark, folder)).withColumn("window_end", plain("window_end"))


HOP_VELOCITY_BATCH = f"WITH {HOPS} SELECT * FROM hops"


def hop_velocity_scaled(spark, folder):
    """The windows with amounts a million times smaller and a trillion times larger."""
    parts = [
        hop_velocity(events(spark, folder).withColumn("amount", F.col("amount") * F.lit(factor)))
        .withColumn("window_end", plain("window_end"))
        .withColumn("scale", F.lit(name))
        for name, factor in (("tiny", 1e-6), ("huge", 1e12))
    ]
    return parts[0].unionByName(parts[1])


HOP_VELOCITY_SCALED = " UNION ALL ".join(
    f"""SELECT user_id, count(*) AS txn_count_5m, {exact(f'amount * {factor!r}::DOUBLE')} AS txn_amount_sum_5m,
         count(*) / 5.0::DOUBLE AS velocity_per_min, window_end, '{name}' AS scale
  FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, value AS amount,
               date_trunc('minute', ts) + to_minutes(i) AS window_end FROM events, range(1, 6) t(i))
  GROUP BY user_id, window_end"""
    for name, factor in (("tiny", 1e-6), ("huge", 1e12))
)


def hop_velocity_tumbling(spark, folder):
    return _streamed(spark, folder, width="5 minutes", slide="5 minutes")


HOP_VELOCITY_TUMBLING = f"""WITH {EVENT_TXNS}, w AS (
  SELECT user_id, count(*) AS txn_count_5m, {exact('amount')} AS txn_amount_sum_5m,
         count(*) / 5.0::DOUBLE AS velocity_per_min,
         time_bucket(INTERVAL 5 MINUTES, event_ts) + INTERVAL 5 MINUTES AS window_end
  FROM events_t GROUP BY user_id, window_end)
SELECT * FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 10 SECONDS FROM events)"""


def _arrivals(spark: SparkSession, folder: str):
    """Events, and in which of four parts each arrives: ten days at a time, errors ten days late."""
    txns = events(spark, folder).select(
        "transaction_id", "user_id", "merchant_id", "amount", "event_ts", "event_type"
    )
    third = F.least(F.floor((F.dayofmonth("event_ts") - 1) / 10), F.lit(2))
    return txns, third + F.when(F.col("event_type") == "error", 1).otherwise(0)


def late_drops(spark, folder):
    """Errors arrive ten days late, after their windows closed: what was kept, and what dropped.

    Each arrival is one run of the same query (same checkpoint).
    """
    root, session = work_folder(spark, "late"), streaming_session(spark)
    txns, arrival = _arrivals(spark, folder)
    late = LateRows()
    session.streams.addListener(late)
    for step in range(4):
        txns.where(arrival == step).write.parquet(f"{root}/in/arrival={step}")
        stream = session.readStream.schema(txns.schema).parquet(f"{root}/in/*")
        query = append_to_folder(hop_velocity(stream), f"{root}/out", f"{root}/checkpoint")
        dropped = late.total(query)
    session.streams.removeListener(late)
    kept = spark.read.parquet(f"{root}/out")
    return kept.agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("txn_count_5m").alias("events_in_windows"),
        F.lit(dropped).cast("long").alias("windows_dropped"),
    )


LATE_DROPS = f"""WITH {EVENT_TXNS}, a AS (
  SELECT *, least((day(event_ts) - 1) // 10, 2) + CAST(event_type = 'error' AS INT) AS arrival
  FROM events_t),
seen AS (SELECT s.step, (SELECT max(event_ts) - INTERVAL 10 SECONDS FROM a WHERE arrival < s.step) AS wm
  FROM range(6) s(step)),
w AS (SELECT user_id, arrival, date_trunc('minute', event_ts) + to_minutes(i) AS window_end
  FROM a, range(1, 6) t(i)),
kept AS (SELECT w.* FROM w JOIN seen ON seen.step = w.arrival
  WHERE (wm IS NULL OR window_end > wm) AND window_end <= (SELECT wm FROM seen WHERE step = 5))
SELECT count(DISTINCT (user_id, window_end)) AS windows, count(*) AS events_in_windows,
       (SELECT count(DISTINCT (arrival, user_id, window_end)) FROM w JOIN seen ON seen.step = w.arrival
        WHERE window_end <= wm) AS windows_dropped FROM kept"""


def _dual(spark: SparkSession, folder: str, ttl: timedelta, snapshot: bool):
    root, session = work_folder(spark, "dual"), streaming_session(apply_settings(spark))
    online = LatestTable(spark, f"{root}/online", "transaction_velocity_v1", VELOCITY_FEATURES)
    offline = FeatureTable(spark, f"{root}/offline", "transaction_velocity_v1", VELOCITY_FEATURES)
    stream = as_feature_rows(hop_velocity(event_stream(session, folder)))
    dual_write(
        stream,
        f"{root}/checkpoint",
        online=online,
        offline=offline if snapshot else None,
        ttl=ttl,
        written=F.col("event_ts"),
    )
    return online, offline


def stream_upsert(spark, folder):
    """The newest closed window of every user, ten minutes to live."""
    online, _ = _dual(spark, folder, VELOCITY_TTL, snapshot=False)
    return online.rows().withColumns(
        {c: plain(c) for c in ("event_ts", "written_ts", "expires_at")}
    )


STREAM_UPSERT = f"""WITH {HOPS}
SELECT user_id AS entity_id, txn_count_5m, txn_amount_sum_5m, velocity_per_min,
       window_end AS event_ts, window_end AS written_ts,
       window_end + INTERVAL 600 SECONDS AS expires_at
FROM closed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_end DESC) = 1"""


def stream_snapshot(spark, folder):
    """Every closed window kept offline, beside the online copy of the same batches."""
    online, offline = _dual(spark, folder, SINK_TTL, snapshot=True)
    newest = online.rows().select("entity_id", "event_ts", F.lit(True).alias("online_now"))
    stored = offline.read_range(at("2024-01-01"), at("2024-02-01"))
    both = stored.join(newest, ["entity_id", "event_ts"], "left")
    return both.select(
        "entity_id",
        plain("event_ts").alias("event_ts"),
        "txn_count_5m",
        "txn_amount_sum_5m",
        "velocity_per_min",
        F.coalesce("online_now", F.lit(False)).alias("online_now"),
    )


STREAM_SNAPSHOT = f"""WITH {HOPS}
SELECT user_id AS entity_id, window_end AS event_ts, txn_count_5m, txn_amount_sum_5m,
       velocity_per_min,
       row_number() OVER (PARTITION BY user_id ORDER BY window_end DESC) = 1 AS online_now FROM closed"""


def sliding_state(spark, folder):
    """Trailing six hours per event, the stream arriving in three parts."""
    root, session = work_folder(spark, "sliding"), streaming_session(spark)
    txns = events(spark, folder).select("transaction_id", "user_id", "event_ts", "amount")
    third = F.least(F.floor((F.dayofmonth("event_ts") - 1) / 10), F.lit(2))
    for step in range(3):
        txns.where(third == step).write.parquet(f"{root}/in/part={step}")
        stream = session.readStream.schema(txns.schema).parquet(f"{root}/in/*")
        sliding_stream(
            stream, ["user_id"], timedelta(hours=6), f"{root}/out", f"{root}/checkpoint"
        )
    counted = spark.read.parquet(f"{root}/out").drop("batch")
    return counted.withColumn("event_ts", plain("event_ts"))


def late_drops_dual(spark, folder):
    """The same arrivals through both tables, with a new listener at each start: windows kept online and offline, dropped."""
    root, session = work_folder(spark, "late-dual"), streaming_session(spark)
    online = LatestTable(spark, f"{root}/online", "velocity", VELOCITY_FEATURES)
    offline = FeatureTable(spark, f"{root}/offline", "velocity", VELOCITY_FEATURES)
    txns, arrival = _arrivals(spark, folder)
    for step in range(4):
        late = LateRows(spark, f"{root}/late")
        session.streams.addListener(late)
        txns.where(arrival == step).write.parquet(f"{root}/in/arrival={step}")
        stream = session.readStream.schema(txns.schema).parquet(f"{root}/in/*")
        query = dual_write(
            as_feature_rows(hop_velocity(stream)),
            f"{root}/checkpoint",
            online=online,
            offline=offline,
            written=F.col("event_ts"),
        )
        dropped = late.total(query)
        session.streams.removeListener(late)
    kept = offline.read_range(at("2024-01-01"), at("2024-03-01")).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("txn_count_5m").alias("events_in_windows")
    )
    users = online.rows().agg(F.count(F.lit(1)).alias("users"))
    return kept.withColumn("windows_dropped", F.lit(dropped).cast("long")).join(users)


LATE_DROPS_DUAL = LATE_DROPS.replace(
    "SELECT count(DISTINCT (user_id, window_end)) AS windows,",
    "SELECT count(DISTINCT user_id) AS users, count(DISTINCT (user_id, window_end)) AS windows,",
)


def stream_side_outputs(spark, folder):
    """Events as JSON, some cut short, errors ten days late: what reaches the sink, what is malformed and what is late.

    Each arrival is a run of its own, and the last batch is run a second time by a query that lost its progress.
    """
    root, session = work_folder(spark, "sides"), streaming_session(spark)
    txns, arrival = _arrivals(spark, folder)
    fields = ("transaction_id", "user_id", "merchant_id", "amount", "event_ts")
    text = F.to_json(F.struct(*[(F.col(c).cast("string") if c == "transaction_id" else F.col(c)).alias(c) for c in fields]))
    cut = F.when(F.col("transaction_id") % 50 == 7, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value"))
    messages = txns.withColumns({"value": text, "_arrival": arrival}).withColumn("value", cut)

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    for step in range(4):
        messages.where(F.col("_arrival") == step).select("value").write.parquet(f"{root}/in/arrival={step}")
        stream = session.readStream.schema("value string").parquet(f"{root}/in/*")
        side_outputs(stream, f"{root}/checkpoint", f"{root}/sides", sink)
    kept = spark.read.parquet(f"{root}/out").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.col("transaction_id").cast("long")).alias("kept_ids")
    )
    return side_totals(spark, f"{root}/sides").join(kept)


STREAM_SIDE_OUTPUTS = f"""WITH {EVENT_TXNS}, a AS (
  SELECT *, transaction_id % 50 = 7 AS bad, least((day(event_ts) - 1) // 10, 2) + CAST(event_type = 'error' AS INT) AS arrival
  FROM events_t),
seen AS (SELECT s.step, (SELECT max(event_ts) - INTERVAL 10 SECONDS FROM a WHERE arrival < s.step AND NOT bad) AS wm
  FROM range(4) s(step)),
judged AS (SELECT a.*, NOT bad AND wm IS NOT NULL AND event_ts <= wm AS late FROM a JOIN seen ON seen.step = a.arrival)
SELECT count(*) AS messages, count(*) FILTER (bad) AS malformed, count(*) FILTER (late) AS late,
  count(*) FILTER (NOT bad AND NOT late) AS kept,
  CAST(sum(transaction_id) FILTER (NOT bad AND NOT late) AS BIGINT) AS kept_ids FROM judged"""


def sliding_state_keyed(spark, folder):
    """The same windows from keyed state; ten users are split into three sub-keys each."""
    root, session = work_folder(spark, "keyed"), streaming_session(apply_settings(spark))
    txns = events(spark, folder).select(
        "transaction_id", "user_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "amount"
    )
    third = F.least(F.floor((F.dayofmonth("event_ts") - 1) / 10), F.lit(2))
    for step in range(3):
        txns.where(third == step).write.parquet(f"{root}/in/part={step}")
        stream = session.readStream.schema(txns.schema).parquet(f"{root}/in/*")
        keyed_sliding_stream(
            stream,
            ["user_id"],
            timedelta(hours=6),
            f"{root}/out",
            f"{root}/checkpoint",
            event_id="transaction_id",
            split={(str(user),): 3 for user in range(10)},
        )
    return spark.read.parquet(f"{root}/out").drop("batch").withColumn("event_ts", plain("event_ts"))


SLIDING_STATE_KEYED = f"SELECT * EXCLUDE (amount) FROM ({SLIDING_WINDOW})"


QUERIES = {
    "hop_velocity_scaled": hop_velocity_scaled,
    "hop_velocity_stream": hop_velocity_stream,
    "hop_velocity_batch": hop_velocity_batch,
    "hop_velocity_tumbling": hop_velocity_tumbling,
    "late_drops": late_drops,
    "late_drops_dual": late_drops_dual,
    "stream_side_outputs": stream_side_outputs,
    "stream_upsert": stream_upsert,
    "stream_snapshot": stream_snapshot,
    "sliding_state": sliding_state,
    "sliding_state_keyed": sliding_state_keyed,
}
ORACLES = {
    "hop_velocity_scaled": HOP_VELOCITY_SCALED,
    "hop_velocity_stream": HOP_VELOCITY_STREAM,
    "hop_velocity_batch": HOP_VELOCITY_BATCH,
    "hop_velocity_tumbling": HOP_VELOCITY_TUMBLING,
    "late_drops": LATE_DROPS,
    "late_drops_dual": LATE_DROPS_DUAL,
    "stream_side_outputs": STREAM_SIDE_OUTPUTS,
    "stream_upsert": STREAM_UPSERT,
    "stream_snapshot": STREAM_SNAPSHOT,
    "sliding_state": SLIDING_WINDOW,
    "sliding_state_keyed": SLIDING_STATE_KEYED,
}
