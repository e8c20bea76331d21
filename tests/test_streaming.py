from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.rolling import sliding_window
from tidemark.sources.feature_table import FeatureTable
from tidemark.sources.latest_table import LatestTable
from tidemark.streaming.sinks import (
    VELOCITY_FEATURES,
    VELOCITY_TTL,
    as_feature_rows,
    dual_write,
    upsert_online,
)
from tidemark.streaming.keyed import keyed_sliding_stream, window_sums
from tidemark.streaming.side_outputs import side_outputs, side_totals
from tidemark.streaming.sliding import sliding_stream
from tidemark.streaming.velocity import (
    LateRows,
    append_to_folder,
    hop_velocity,
    streaming_session,
)

SCHEMA = "transaction_id long, user_id string, amount double, event_ts timestamp"
BASE = datetime(2026, 5, 1)


def batch(spark, n, start, seed):
    rng = random.Random(seed)
    rows = [
        (start * 1000 + i, rng.choice("ab"), 1.5, BASE + timedelta(seconds=600 * start + rng.randrange(600)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "in")
    session = streaming_session(spark)

    def add(df):
        df.write.mode("append").parquet(folder)

    def stream():
        return session.readStream.schema(SCHEMA).parquet(folder)

    return add, stream


def windows(df):
    return sorted(
        (r["user_id"], r["window_end"], r["txn_count_5m"], r["txn_amount_sum_5m"], r["velocity_per_min"])
        for r in df.collect()
    )


def test_stream_equals_batch_up_to_the_watermark(spark, feed, tmp_path):
    add, stream = feed
    whole = None
    for step in range(3):
        part = batch(spark, 60, step, step)
        add(part)
        append_to_folder(hop_velocity(stream()), str(tmp_path / "out"), str(tmp_path / "ck"))
        whole = part if whole is None else whole.unionByName(part)
    end = whole.agg(F.max("event_ts")).first()[0] - timedelta(seconds=10)
    expected = windows(hop_velocity(whole).where(F.col("window_end") <= F.lit(end)))
    assert windows(spark.read.parquet(str(tmp_path / "out"))) == expected and expected


def test_a_timed_query_keeps_running(spark, feed, tmp_path):
    add, stream = feed
    add(batch(spark, 20, 0, 1))
    query = append_to_folder(
        hop_velocity(stream()), str(tmp_path / "out"), str(tmp_path / "ck"), every="1 second"
    )
    query.processAllAvailable()
    assert query.isActive and query.lastProgress["numInputRows"] >= 0
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_late_rows_are_dropped(spark, feed, tmp_path):
    add, stream = feed
    add(batch(spark, 50, 5, 1))
    append_to_folder(hop_velocity(stream()), str(tmp_path / "out"), str(tmp_path / "ck"))
    add(batch(spark, 20, 0, 2))
    late = LateRows()
    session = stream().sparkSession
    session.streams.addListener(late)
    query = append_to_folder(hop_velocity(stream()), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert late.total(query) > 0
    session.streams.removeListener(late)
    early = spark.read.parquet(str(tmp_path / "out")).where(F.col("window_end") < F.lit(BASE + timedelta(hours=0.5)))
    assert early.count() == 0


def test_dual_write_keeps_newest_online_and_all_offline(spark, feed, tmp_path):
    add, stream = feed
    online = LatestTable(spark, str(tmp_path / "on"), "velocity", VELOCITY_FEATURES, buckets=2)
    offline = FeatureTable(spark, str(tmp_path / "off"), "velocity", VELOCITY_FEATURES)
    for step in range(2):
        add(batch(spark, 40, step, step))
        dual_write(
            as_feature_rows(hop_velocity(stream())),
            str(tmp_path / "ck"),
            online=online,
            offline=offline,
            ttl=VELOCITY_TTL,
            written=F.col("event_ts"),
        )
    kept = offline.read_range(BASE, BASE + timedelta(days=1))
    newest = {r["entity_id"]: r["t"] for r in kept.groupBy("entity_id").agg(F.max("event_ts").alias("t")).collect()}
    rows = online.rows().collect()
    assert {r["entity_id"]: r["event_ts"] for r in rows} == newest
    assert all(r["expires_at"] - r["written_ts"] == VELOCITY_TTL for r in rows)
    assert kept.count() == kept.select("entity_id", "event_ts").distinct().count() > len(rows)
    before = sorted(map(tuple, rows))
    older = kept.orderBy("event_ts").limit(3)
    upsert_online(older, online, ttl=VELOCITY_TTL, written=F.col("event_ts"))
    assert sorted(map(tuple, online.rows().collect())) == before


def test_sliding_state_carries_over_and_drops_late_events(spark, feed, tmp_path):
    add, stream = feed
    width = timedelta(minutes=7)
    run = lambda: sliding_stream(
        stream(), ["user_id"], width, str(tmp_path / "out"), str(tmp_path / "ck")
    )
    parts = [batch(spark, 50, step, step) for step in range(3)]
    for part in parts:
        add(part)
        run()
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    expected = sliding_window(whole, ["user_id"], width, value="amount")
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    key = lambda df: sorted(map(tuple, df.select(*expected.columns).collect()))
    assert key(got) == key(expected)
    add(batch(spark, 5, 0, 9).withColumn("transaction_id", F.lit(-1).cast("long")))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).where("transaction_id = -1").count() == 0


def test_events_without_a_time_come_out_in_every_batch(spark, feed, tmp_path):
    add, stream = feed
    for step in range(2):
        part = batch(spark, 10, step, step)
        add(part.unionByName(part.limit(2).withColumn("event_ts", F.lit(None).cast("timestamp"))))
        sliding_stream(
            stream(), ["user_id"], timedelta(minutes=7), str(tmp_path / "out"), str(tmp_path / "ck")
        )
    out = spark.read.parquet(str(tmp_path / "out")).where("event_ts IS NULL")
    assert sorted(r["batch"] for r in out.collect()) == [0, 0, 1, 1]


def test_a_batch_is_computed_once_and_late_counts_outlive_the_listener(spark, feed, tmp_path):
    """The file sink and the dual write drop as many, and a listener made after a restart goes on counting."""
    add, stream = feed
    session, totals = stream, {}
    add(batch(spark, 50, 5, 1))
    stream_of = lambda: hop_velocity(stream())
    online = LatestTable(spark, str(tmp_path / "on"), "velocity", VELOCITY_FEATURES, buckets=2)
    offline = FeatureTable(spark, str(tmp_path / "off"), "velocity", VELOCITY_FEATURES)
    runs = {
        "file": lambda: append_to_folder(stream_of(), str(tmp_path / "out"), str(tmp_path / "ck1")),
        "dual": lambda: dual_write(
            as_feature_rows(stream_of()), str(tmp_path / "ck2"), online=online, offline=offline, written=F.col("event_ts")
        ),
    }
    for run in runs.values():
        run()
    for step in range(2):
        add(batch(spark, 20, step, 2 + step))
        for name, run in runs.items():
            late = LateRows(spark, str(tmp_path / "late" / name))
            session = stream().sparkSession
            session.streams.addListener(late)
            totals[name, step] = late.total(run())
            session.streams.removeListener(late)
    assert totals["file", 0] == totals["dual", 0] > 0
    assert totals["file", 1] == totals["dual", 1] > totals["file", 0]


def test_side_outputs_are_counted_once_and_survive_replays(spark, tmp_path):
    messages = str(tmp_path / "in")
    session = streaming_session(spark)

    def add(*texts):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").parquet(messages)

    def text(i, minute):
        return f'{{"transaction_id":"{i}","user_id":"u","amount":1.5,"event_ts":"2026-05-01T00:{minute:02d}:00Z"}}'

    fail, kept = [True], {}

    def sink(df, batch_id):
        kept[batch_id] = sorted(r["transaction_id"] for r in df.collect())
        if batch_id == 1 and fail.pop():
            raise RuntimeError("lost")

    def run():
        stream = session.readStream.schema("value string").parquet(messages)
        side_outputs(stream, str(tmp_path / "ck"), str(tmp_path / "sides"), sink)

    assert side_totals(spark, str(tmp_path / "sides")).first()["messages"] == 0
    add(text(1, 10), text(2, 30), "{broken", "", None)
    run()
    add(text(3, 5), text(4, 40), "[1, 2]", text(5, 29))
    with pytest.raises(Exception, match="lost"):
        run()
    fail.append(False)
    run()
    add(text(6, 35), text(7, 41))
    run()
    assert kept == {0: ["1", "2"], 1: ["4"], 2: ["7"]}
    total = side_totals(spark, str(tmp_path / "sides")).first()
    assert (total["messages"], total["malformed"], total["late"]) == (11, 4, 3)
    bad = spark.read.parquet(str(tmp_path / "sides/malformed")).collect()
    assert sorted(r["malformed"] for r in bad) == ["", "", "[1, 2]", "{broken"]
    late = spark.read.parquet(str(tmp_path / "sides/late")).collect()
    assert sorted(r["transaction_id"] for r in late) == ["3", "5", "6"]


@pytest.mark.parametrize("split", [None, {("a",): 3}])
def test_keyed_state_equals_the_batch_operator_and_forgets(spark, feed, tmp_path, split):
    add, stream = feed
    width = timedelta(minutes=7)

    def run():
        return keyed_sliding_stream(
            stream(), ["user_id"], width, str(tmp_path / "out"), str(tmp_path / "ck"), event_id="transaction_id", split=split
        )

    parts = [batch(spark, 50, step, step) for step in range(3)]
    for part in parts:
        add(part)
        run()
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["transaction_id", "user_id", "event_ts", "window_count", "window_sum", "velocity_per_min"]
    expected = sliding_window(whole, ["user_id"], width, value="amount")
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    key = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert key(got) == key(expected)
    # One event far ahead: the next run drops the state of everybody else, and events that are late by then.
    add(batch(spark, 1, 40, 5))
    run()
    late = batch(spark, 5, 0, 9).withColumn("transaction_id", F.lit(-1).cast("long"))
    odd = late.withColumn("event_ts", F.lit(None).cast("timestamp")).unionByName(late)
    add(odd)
    query = run()
    assert spark.read.parquet(str(tmp_path / "out")).where("transaction_id = -1").count() == 0
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] <= 3


def test_users_share_groups_of_keyed_state(spark, tmp_path):
    """Two hundred users in three groups: three rows of state, and no user's values reach another's sums."""
    session, names = streaming_session(spark), "transaction_id long, user_id string, event_ts timestamp, amount double"
    rows = spark.range(1000).selectExpr(
        "id AS transaction_id",
        "CAST(id % 200 AS string) AS user_id",
        "timestamp_seconds(1700000000 + id) AS event_ts",
        "CASE WHEN id % 200 = 7 THEN 1e12 ELSE id / 4 END AS amount",
    )
    expected = sliding_window(rows, ["user_id"], timedelta(seconds=300), value="amount")
    rows.write.parquet(str(tmp_path / "in"))
    query = keyed_sliding_stream(
        session.readStream.schema(names).parquet(str(tmp_path / "in")),
        ["user_id"],
        timedelta(seconds=300),
        str(tmp_path / "out"),
        str(tmp_path / "ck"),
        event_id="transaction_id",
        groups=3,
    )
    operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(o["numRowsTotal"] for o in operators) <= 3
    # State is on disk, not in the heap of the executors.
    assert all("rocksdbPutCount" in o["customMetrics"] for o in operators)
    columns = ["transaction_id", "user_id", "event_ts", "window_count", "window_sum"]
    got = spark.read.parquet(str(tmp_path / "out"))
    have, want = (sorted(map(tuple, df.select(columns).collect())) for df in (got, expected))
    assert have == want


def test_window_sums_against_plain_sums():
    rng = np.random.default_rng(2)
    at = np.sort(rng.integers(0, 50, 200))
    value = rng.choice([0.1, 1e9, -2.5, 3e-7, np.nan, np.inf], 200, p=[0.4, 0.2, 0.2, 0.18, 0.01, 0.01])
    ask = np.arange(60)
    n, total = window_sums(at, value, ask, 5)
    for t, k, s in zip(ask, n, total):
        inside = value[(at >= t - 5) & (at <= t)]
        assert k == len(inside) and s == pytest.approx(inside.sum(), rel=1e-13, nan_ok=True)
