from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import day, explained, shuffles
from tidemark.operators.batch_features import user_activity_by_day, user_peaks
from tidemark.operators.sums import double_sum
from tidemark.operators.rolling import (
    amount_zscores,
    rolling_features,
    seconds_since_previous,
    sliding_window,
)

SCHEMA = "id long, user_id string, merchant_id string, amount double, event_ts timestamp_ntz"
BASE = datetime(2026, 5, 1)


def transactions(n=300, seed=3):
    """One user has half the rows, and many of those share an instant and a merchant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = rng.choice(["hot", "hot", "a", "b"])
        crowded = user == "hot" and rng.random() < 0.3
        hour = 200 if crowded else rng.randrange(400)
        merchant = rng.choice(["m1", "m1", "m1", "m2", "m3", "m4", None])
        amount = None if rng.random() < 0.05 else round(rng.uniform(0, 99), 2)
        rows.append((i, user, merchant, amount, BASE + timedelta(hours=hour)))
    return rows


def frame(rows, row, width):
    return [r for r in rows if r[1] == row[1] and row[4] - width <= r[4] <= row[4]]


@pytest.mark.parametrize("rows_per_slice", [None, 2, 11])
def test_totals_and_distinct_against_brute_force(spark, rows_per_slice):
    rows, width = transactions(), timedelta(hours=48)
    out = rolling_features(
        spark.createDataFrame(rows, SCHEMA),
        ["user_id"],
        width,
        spread=True,
        distinct={"merchant_id": "merchants"},
        rows_per_slice=rows_per_slice,
    ).collect()
    assert len(out) == len(rows)
    for got in out:
        row = next(r for r in rows if r[0] == got["id"])
        window = frame(rows, row, width)
        amounts = [r[3] for r in window if r[3] is not None]
        assert got["txn_count_30d"] == len(window)
        assert got["merchants"] == len({r[2] for r in window} - {None})
        if amounts:
            assert got["txn_amount_sum_30d"] == pytest.approx(sum(amounts))
            assert got["txn_amount_avg_30d"] == pytest.approx(sum(amounts) / len(amounts))
        else:
            assert got["txn_amount_sum_30d"] is None
        if len(amounts) > 1:
            std = statistics.stdev(amounts)
            assert got["txn_amount_std_30d"] == pytest.approx(std, abs=1e-9)


@pytest.mark.parametrize("rows_per_slice", [None, 2, 11])
def test_seconds_since_previous_against_brute_force(spark, rows_per_slice):
    rows = transactions()
    out = seconds_since_previous(
        spark.createDataFrame(rows, SCHEMA), ["user_id"], tie="id", rows_per_slice=rows_per_slice
    ).collect()
    assert len(out) == len(rows)
    for got in out:
        before = [r for r in rows if r[1] == got["user_id"]]
        before = [r for r in before if (r[4], r[0]) < (got["event_ts"], got["id"])]
        newest = max((r[4] for r in before), default=None)
        gap = None if newest is None else int((got["event_ts"] - newest).total_seconds())
        assert got["seconds_since_prev_txn"] == gap


def test_rows_without_key_or_time_keep_a_place_but_get_no_window(spark):
    rows = [(1, None, "m", 1.0, BASE), (2, "u", "m", 1.0, None), (3, "u", None, 2.0, BASE)]
    out = rolling_features(
        spark.createDataFrame(rows, SCHEMA),
        ["user_id"],
        timedelta(days=1),
        distinct={"merchant_id": "merchants"},
    )
    got = {r["id"]: (r["txn_amount_sum_30d"], r["merchants"]) for r in out.collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (2.0, 0)}


def test_sliding_window_is_closed_and_evicts(spark):
    minutes = [(i, "u", None, float(i), BASE + timedelta(minutes=i)) for i in range(6)]
    later = [(9, "u", None, 1.0, BASE + timedelta(minutes=11))]
    df = spark.createDataFrame(minutes + later, SCHEMA)
    out = sliding_window(df, ["user_id"], timedelta(minutes=5), value="amount")
    got = {r["id"]: r for r in out.collect()}
    assert (got[5]["window_count"], got[5]["window_sum"]) == (6, 15.0)
    assert (got[9]["window_count"], got[9]["window_sum"]) == (1, 1.0)
    assert got[4]["velocity_per_min"] == 1.0


def test_equal_amounts_score_zero(spark):
    rows = [(i, "u", None, 0.1, BASE + timedelta(hours=i)) for i in range(20)]
    out = amount_zscores(spark.createDataFrame(rows, SCHEMA), ["user_id"], timedelta(days=30))
    assert {r["amount_zscore_user_30d"] for r in out.collect()} == {0.0}


def test_very_large_amounts_fall_back_to_doubles(spark):
    """n times the sum of squares passes 1e32, what the products can hold; the sums still fit 1e30."""
    amounts = [1.1e13, 1.0e13, 0.9e13]
    rows = [(i, "u", None, a, BASE + timedelta(hours=i)) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows * 400, SCHEMA)
    out = rolling_features(df, ["user_id"], timedelta(days=30), spread=True)
    last = out.where("id = 2").first()
    assert last["txn_amount_std_30d"] == pytest.approx(statistics.stdev(amounts * 400), rel=1e-6)


def test_peaks_are_the_highest_windows_ever(spark):
    rows = [(i, "u", f"m{i}", 10.0, BASE + timedelta(days=d)) for i, d in enumerate((0, 1, 2, 90))]
    peak = user_peaks(spark.createDataFrame(rows, SCHEMA), day(1, month=12)).first()
    assert (peak["txn_count_30d"], peak["distinct_merchants_30d"]) == (3, 3)


def test_daily_activity_window_is_closed_at_both_midnights(spark):
    rows = [
        (1, "u", "m", 1.0, datetime(2026, 4, 1)),
        (2, "u", "m", 2.0, datetime(2026, 4, 1, 0, 0, 1)),
        (3, "u", "n", 4.0, datetime(2026, 5, 1)),
        (4, "u", "n", 8.0, datetime(2026, 5, 1, 0, 0, 1)),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    days = [datetime(2026, 5, d).date() for d in (1, 2)]
    out = {r["event_ts"].day: r for r in user_activity_by_day(df, days).collect()}
    assert (out[1]["txn_count_30d"], out[1]["txn_amount_sum_30d"]) == (3, 7.0)
    assert (out[2]["txn_count_30d"], out[2]["distinct_merchants_30d"]) == (2, 1)


def test_totals_read_the_input_once_and_shuffle_once(spark, tmp_path):
    spark.createDataFrame(transactions(), SCHEMA).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    out = rolling_features(stored.where("user_id IS NOT NULL"), ["user_id"], timedelta(days=1))
    assert shuffles(out) == 1


def test_small_amounts_keep_their_digits(spark):
    rows = [(i, "u", None, 0.00004, BASE + timedelta(hours=i)) for i in range(10)]
    out = rolling_features(spark.createDataFrame(rows, SCHEMA), ["user_id"], timedelta(days=30))
    last = out.where("id = 9").first()
    assert last["txn_amount_sum_30d"] == pytest.approx(0.0004, rel=1e-12)
    assert last["txn_amount_avg_30d"] == pytest.approx(0.00004, rel=1e-12)


def test_tiny_amounts_and_squares_are_summed(spark):
    amounts = [2e-12, 4e-12, -3e-20, 5.0]
    rows = [(i, "u", None, a, BASE + timedelta(days=15 * i)) for i, a in enumerate(amounts)]
    out = rolling_features(spark.createDataFrame(rows, SCHEMA), ["user_id"], timedelta(days=16), spread=True)
    got = {r["id"]: r for r in out.collect()}
    assert got[0]["txn_amount_sum_30d"] == 2e-12
    assert got[1]["txn_amount_std_30d"] == pytest.approx(statistics.stdev(amounts[:2]), rel=1e-9, abs=0)
    assert got[2]["txn_amount_sum_30d"] == pytest.approx(4e-12 - 3e-20, rel=1e-12, abs=0)
    assert got[3]["txn_amount_sum_30d"] == 5.0


def test_large_and_negative_amounts_sum_exactly(spark):
    amounts = [3e14, -3e14, 0.1, 2.0**60, -(2.0**60), -0.25]
    rows = [(i, "u", None, a, BASE + timedelta(hours=i)) for i, a in enumerate(amounts)]
    out = rolling_features(spark.createDataFrame(rows, SCHEMA), ["user_id"], timedelta(days=30))
    assert out.where("id = 5").first()["txn_amount_sum_30d"] == pytest.approx(-0.15, rel=1e-12)


@pytest.mark.parametrize("rows_per_slice", [3, 8, None])
def test_gaps_are_the_same_however_keys_are_split(spark, rows_per_slice):
    rows = [(i // 2, "u", None, float(i), BASE) for i in range(60)]
    rows += [(100 + i, "u", None, 1.0, BASE + timedelta(days=1 + i // 4)) for i in range(40)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    out = seconds_since_previous(df, ["user_id"], tie="id", rows_per_slice=rows_per_slice)
    gaps = [r["seconds_since_prev_txn"] for r in out.collect()]
    assert gaps.count(None) == 1 and gaps.count(0) == 79 + 30 and gaps.count(86400) == 10


@pytest.mark.parametrize("rows_per_slice", [None, 2, 5])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_special_values_leave_with_their_rows(spark, rows_per_slice, ansi):
    """Windows of three rows: NaN, infinities and 1e39 count only while they are inside."""
    nan, inf = float("nan"), float("inf")
    amounts = [1.0, nan, 2.0, 3.0, 4.0, inf, 5.0, -inf, 6.0, 7.0, 8.0, 1e39, 1.0, None, 0.5, 0.25]
    rows = [(i, "u", None, a, BASE + timedelta(hours=i)) for i, a in enumerate(amounts)]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        out = rolling_features(df, ["user_id"], timedelta(hours=2), rows_per_slice=rows_per_slice)
        got = {r["id"]: r["txn_amount_sum_30d"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    for i in range(len(amounts)):
        want = sum(a for a in amounts[max(0, i - 2) : i + 1] if a is not None)
        assert got[i] == pytest.approx(want, rel=1e-15, nan_ok=True)


@pytest.mark.parametrize("rows_per_slice", [None, 2])
def test_spread_far_from_zero(spark, rows_per_slice):
    for amounts in ([1e9, 1e9 + 1, 1e9 + 2], [1e8, 1e8 + 0.5, 1e8 + 1], [-1e12, -1e12 + 0.25, -1e12 - 0.25] * 4, [1e15] * 5):
        rows = [(i, "u", None, a, BASE + timedelta(hours=i)) for i, a in enumerate([5.0, -7e14, *amounts])]
        rows = [(i, u, m, a, t if i > 1 else t - timedelta(days=40)) for i, u, m, a, t in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        out = rolling_features(df, ["user_id"], timedelta(days=30), spread=True, rows_per_slice=rows_per_slice)
        last = out.where(F.col("id") == len(rows) - 1).first()
        assert last["txn_amount_std_30d"] == pytest.approx(statistics.stdev(amounts), rel=1e-9)


def test_sums_beyond_the_limbs_are_an_error(spark):
    df = spark.createDataFrame([(1, "u", None, 1e60, BASE)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        rolling_features(df, ["user_id"], timedelta(days=1)).collect()


def test_plain_sums_have_special_values(spark):
    nan, inf = float("nan"), float("inf")
    for values in ([1.0, nan], [1.0, inf], [inf, -inf], [1e39, 1.0], [0.1] * 10, [None], [None, 2.5], [2.0**60, 0.5, -(2.0**60)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got, plain_sum = df.agg(double_sum("x"), F.sum("x")).first()
        assert got == plain_sum or got == pytest.approx(plain_sum, rel=1e-15, nan_ok=True) or values[0] == 2.0**60


def test_windows_of_small_keys_need_no_decimals(spark):
    df = spark.createDataFrame(transactions(), SCHEMA)
    small = amount_zscores(df, ["user_id"], timedelta(days=3))
    assert "decimal(38" not in explained(small)
    # One key beyond the limit: the same scores by decimals.
    more = [(1_000 + i, "many", "m1", 1.0, BASE + timedelta(seconds=i)) for i in range(600)]
    large = amount_zscores(df.unionByName(spark.createDataFrame(more, SCHEMA)), ["user_id"], timedelta(days=3))
    assert "decimal(38" in explained(large)
    scores = {r.id: r[-1] for r in small.collect()}
    assert scores == {r.id: r[-1] for r in large.where("id < 1000").collect()}
