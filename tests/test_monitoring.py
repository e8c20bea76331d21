from __future__ import annotations

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import day, explained
from tidemark.operators import health
from tidemark.operators.batch_features import user_activity_by_day
from tidemark.operators.backfill import BackfillLog, run_backfill, run_rollup
from tidemark.operators.drift import baseline_due, drift_report, drift_statistics, long_samples
from tidemark.operators.governance import access_audit, access_decisions
from tidemark.operators.quality import (
    Contract,
    ContractColumn,
    Expectation,
    contract_report,
    quality_report,
    removed_features,
)
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.sampling import join_fanout, sample_rows
from tidemark.sources.feature_table import FeatureTable


def sample_frame(spark, *columns):
    names = [f"f{i}" for i in range(len(columns))]
    data = list(zip(*[[float(x) for x in c] for c in columns], strict=True))
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))


def normal(mean, n, seed):
    return np.random.default_rng(seed).normal(mean, 1, n)


def expected_psi(base, cur):
    edges = np.unique(np.quantile(base, np.arange(11) / 10))
    share = lambda x: np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None)
    e, a = share(base), share(cur)
    return float(np.sum((a - e) * np.log(a / e)))


def expected_ks(base, cur):
    points = np.sort(np.concatenate([base, cur]))
    upto = lambda x: np.searchsorted(np.sort(x), points, side="right") / len(x)
    d = float(np.max(np.abs(upto(base) - upto(cur))))
    lam = d * math.sqrt(len(base) * len(cur) / (len(base) + len(cur)))
    if lam < 0.3:
        return d, 1.0
    tail = sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return d, min(max(2 * tail, 0.0), 1.0)


@pytest.mark.parametrize("rows_per_slice", [None, 300])
def test_drift_statistics_equal_numpy(spark, rows_per_slice):
    base, cur = normal(0, 2000, 1), normal(0.4, 2000, 2)
    coarse_base, coarse_cur = np.round(base), np.round(cur)
    samples = long_samples(
        sample_frame(spark, base, coarse_base), sample_frame(spark, cur, coarse_cur), ["f0", "f1", "x"]
    )
    got = {r["feature"]: r for r in drift_statistics(samples, rows_per_slice=rows_per_slice).collect()}
    for name, b, c in (("f0", base, cur), ("f1", coarse_base + 0.0, coarse_cur + 0.0)):
        assert got[name]["psi"] == pytest.approx(expected_psi(b, c), rel=1e-9)
        d, p = expected_ks(b, c)
        assert got[name]["ks_stat"] == pytest.approx(d, rel=1e-12)
        assert got[name]["ks_pvalue"] == pytest.approx(p, rel=1e-9, abs=1e-15)


def report(spark, base, cur):
    samples = long_samples(sample_frame(spark, base), sample_frame(spark, cur), ["f0"])
    return drift_report(samples, "v").first()


def test_identical_samples_are_stable_and_shifted_ones_alert(spark):
    base = normal(0, 5000, 1)
    same = report(spark, base, base)
    assert same["psi"] < 0.01 and same["ks_stat"] == 0 and same["ks_pvalue"] == 1
    assert (same["band"], same["alert"]) == ("stable", False)
    shifted = report(spark, base, normal(2, 5000, 2))
    assert shifted["psi"] > 0.2 and (shifted["band"], shifted["alert"]) == ("alert", True)


def test_constant_and_one_sided_features_do_not_drift(spark):
    still = report(spark, [1.0, 1.0], [1.0, 1.0])
    assert (still["psi"], still["ks_stat"], still["alert"]) == (0.0, 0.0, False)
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "f0 double")
    nothing = spark.createDataFrame([(None,)], "f0 double")
    alone = drift_report(long_samples(frame, nothing, ["f0"]), "v").first()
    assert (alone["n_base"], alone["n_cur"], alone["psi"], alone["ks_pvalue"]) == (1, 0, 0.0, 1.0)


@pytest.mark.parametrize("rows_per_slice", [None, 20])
def test_exact_quantiles_equal_numpy(spark, rows_per_slice):
    rng = random.Random(1)
    data = [(k, round(rng.gauss(0, 1), 1)) for k in "aaaaabc" for _ in range(60)]
    df = spark.createDataFrame(data, "k string, x double")
    for r in exact_quantiles(df, ["k"], "x", [50, 99], rows_per_slice=rows_per_slice).collect():
        values = [x for k, x in data if k == r["k"]]
        assert r["p50"] == pytest.approx(np.quantile(values, 0.5))
        assert r["p99"] == pytest.approx(np.quantile(values, 0.99))


def test_null_rates(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", None), ("c", float("nan")), ("d", 1.0)], "entity_id string, f double"
    )
    assert [tuple(r) for r in health.null_rates(df, 0.5).collect()] == [("f", 0.75, True)]
    assert health.null_rates(df.limit(0)).count() == 0


def test_freshness_of_views_with_and_without_data(spark):
    newest = spark.createDataFrame([("a", day(1))], "feature_view string, latest_event_ts timestamp")
    limits = spark.createDataFrame([("a", "1h"), ("b", "1h")], "feature_view string, sla string")
    got = {r["feature_view"]: r for r in health.freshness(newest, limits, day(1, hours=1)).collect()}
    assert got["a"]["age_seconds"] == 3600.0 and not got["a"]["breached"]
    assert got["b"]["age_seconds"] == float("inf") and got["b"]["breached"]


def skew(spark, online, offline):
    schema = "entity_id string, f double"
    pairs = health.paired(
        spark.createDataFrame(online, schema), spark.createDataFrame(offline, schema), ["f"]
    )
    return health.skew_report(pairs, ["f"]).first()


def test_gaps_of_one_last_bit_are_summed(spark):
    rate = 0.013
    above = math.nextafter(rate, 1)
    rows = [("a", above, rate, "matched"), ("b", rate, rate, "matched"), ("c", 1e-30, 0.0, "matched")]
    pairs = spark.createDataFrame(rows, "entity_id string, f__online double, f__offline double, side string")
    got = health.skew_report(pairs, ["f"]).first()
    assert got["n_compared"] == 3
    assert got["skew"] == pytest.approx(((above - rate + 1e-30) / 3) / (2 * rate / 3 + 1e-9), rel=1e-12, abs=0)


def test_skew(spark):
    same = skew(spark, [("a", 1.0)], [("a", 1.0)])
    assert same["skew"] == 0.0 and not same["alert"]
    off = skew(spark, [(k, 12.0) for k in "abc"], [(k, 10.0) for k in "abc"])
    assert off["skew"] == pytest.approx(0.2) and off["n_compared"] == 3 and off["alert"]
    sides = skew(spark, [("a", 1.0), ("b", 1.0)], [("a", 1.0), ("c", 5.0), ("d", 5.0)])
    assert (sides["n_compared"], sides["online_only"], sides["offline_only"]) == (1, 1, 2)
    assert skew(spark, [("a", 1.0)], [("b", 9.0)])["skew"] == 0.0


def test_alerts_are_routed_by_severity(spark):
    stale = spark.createDataFrame([("v", True)], "feature_view string, breached boolean")
    bands = spark.createDataFrame(
        [("v", "f", "alert"), ("v", "g", "watch"), ("v", "h", "stable")],
        "feature_view string, feature string, band string",
    )
    found = health.freshness_findings(stale), health.drift_findings(bands)
    channels = {"page": "phone", "ticket": "desk", "slack": "room"}
    got = {
        (r["detail"], r["severity"], r["channel"])
        for r in health.route_alerts(spark, *found, channels=channels).collect()
    }
    assert got == {
        ("older than its limit", "page", "phone"), ("f", "ticket", "desk"), ("g", "slack", "room")
    }
    assert {r["channel"] for r in health.route_alerts(spark, *found).collect()} == {"on-call", "tracker", "chat"}


def test_hot_entities_take_ties_by_id(spark):
    reads = spark.createDataFrame(
        [("v", e) for e in "aabbcddd"] + [("w", "z")], "feature_view string, entity_id string"
    )
    got = sorted(tuple(r) for r in health.hot_entities(reads, 2).collect())
    assert got == [("v", "a", 2), ("v", "d", 3), ("w", "z", 1)]


def quality(spark, values, rule, **options):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return quality_report(df, [rule], **options).first()


def test_expectation_null_rules(spark):
    values = [1.0, None, float("nan"), 1.0, 900.0]
    between = quality(spark, values, Expectation("x", "between", {"min": 0, "max": 10}))
    in_set = quality(spark, values, Expectation("x", "in_set", {"values": [1.0]}))
    unique = quality(spark, values, Expectation("x", "unique"))
    not_null = quality(spark, values, Expectation("x", "not_null"))
    assert [r["failing"] for r in (between, in_set, unique, not_null)] == [1, 3, 3, 2]


def test_expectation_tolerance_and_empty_frames(spark):
    values = [float(i) for i in range(100)] + [10_000.0]
    rule = Expectation("x", "between", {"min": 0, "max": 1000})
    assert not quality(spark, values, rule)["passed"]
    assert quality(spark, values, rule, fail_fraction=0.02)["passed"]
    assert quality(spark, values, Expectation("x", "between", rule.params, mostly=0.98))["passed"]
    for nothing in (quality(spark, [], rule), quality(spark, [1.0], Expectation("y", "not_null"))):
        assert nothing["fraction"] == 1.0 and not nothing["passed"]
    assert quality(spark, [1.0], Expectation("x", "of_type", {"type": "float"}))["passed"]
    assert not quality(spark, [1.0], Expectation("x", "of_type", {"type": "string"}))["passed"]
    with pytest.raises(ValueError):
        quality(spark, [1.0], Expectation("x", "odd"))


def test_contract(spark):
    df = spark.createDataFrame([("u", None, day(1))], "user_id string, country string, event_ts timestamp")
    columns = (
        ContractColumn("user_id", "string", nullable=False),
        ContractColumn("country", "string", nullable=False),
        ContractColumn("gone", "long"),
    )
    rows = contract_report(df, Contract("warehouse.users", 3, columns, "6h"), day(1, hours=7)).collect()
    got = {(r["item"], r["check"]): r["ok"] for r in rows}
    assert got[("user_id", "not_null")] and not got[("country", "not_null")]
    assert not got[("gone", "removed")] and not got[("event_ts", "freshness")]
    assert removed_features(df.schema, df.drop("country").schema) == ["country"]


def test_access(spark):
    asked = [("viewer", "pii"), ("ml-engineer", "pii"), ("viewer", "public"), ("visitor", "public")]
    out = access_decisions(spark, spark.createDataFrame(asked, "role string, sensitivity string"))
    got = {(r["role"], r["sensitivity"]): r for r in out.collect()}
    assert not got["viewer", "pii"]["allowed"]
    assert got["viewer", "pii"]["reason"] == "role 'viewer' cannot read pii features"
    assert got["ml-engineer", "pii"]["allowed"] and got["ml-engineer", "pii"]["must_audit"]
    assert got["viewer", "public"]["allowed"] and not got["viewer", "public"]["must_audit"]
    assert not got["visitor", "public"]["allowed"]
    assert [tuple(r) for r in access_audit(out).collect()] == [("ml-engineer", "pii")]


def test_sampling_is_repeatable_and_validated(spark):
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("entity_id"), F.timestamp_seconds("id").alias("event_ts")
    )
    first = {r[0] for r in sample_rows(df, 0.25).collect()}
    again = {r[0] for r in sample_rows(df.repartition(7), 0.25).collect()}
    assert first == again and 800 < len(first) < 1200
    assert first != {r[0] for r in sample_rows(df, 0.25, seed=1).collect()}
    assert sample_rows(df, 1.0).count() == 4000
    for bad in (0, 1.5, -1):
        with pytest.raises(ValueError):
            sample_rows(df, bad)


def test_fanout(spark):
    key = "entity_id string"
    spine = spark.createDataFrame([("a",), ("a",), ("b",)], key)
    features = spark.createDataFrame([("a",)] * 3 + [("c",)], key)
    assert tuple(join_fanout(spine, features).first()) == (2, 3, 1.5)
    assert join_fanout(spine.limit(0), features).first()["fanout"] == 0.0


def test_baseline_cadence():
    assert baseline_due(date(2026, 4, 1), date(2026, 5, 1))
    assert not baseline_due(date(2026, 4, 2), date(2026, 5, 1))


@pytest.fixture
def backfill(spark, tmp_path):
    table = FeatureTable(spark, str(tmp_path), "numbers_v1", "v long")
    calls = []

    def compute(days):
        calls.append(list(days))
        data = [(f"e{i}", day(d.day, month=4), i) for d in days for i in range(10)]
        return spark.createDataFrame(data, "entity_id string, event_ts timestamp, v long")

    log = BackfillLog(spark, str(tmp_path / "state"))
    span = (date(2026, 4, 1), date(2026, 4, 5))
    options = {"requested_by": "me", "now": day(1)}
    return log, table, span, compute, calls, options


def rollup(log):
    rows = run_rollup(log.runs(), log.partitions()).collect()
    return sorted((r["status"], r["partitions_done"], r["rows_written"]) for r in rows)


def test_backfill_runs_once_in_few_jobs(backfill):
    log, table, span, compute, calls, options = backfill
    run_backfill(log, table, *span, compute, dry_run=True, **options)
    assert calls == [] and rollup(log) == [("pending", 0, 0)]
    run_backfill(log, table, *span, compute, **options)
    assert [len(c) for c in calls] == [5]
    run_backfill(log, table, *span, compute, **options)
    assert len(calls) == 1
    assert rollup(log) == [("completed", 0, 0), ("completed", 5, 50), ("pending", 0, 0)]
    assert table.partition_counts().count() == 5


def test_backfill_resumes_after_the_last_finished_job(backfill):
    log, table, span, compute, calls, options = backfill

    def failing(days):
        if days[0].day >= 3:
            raise RuntimeError("lost")
        return compute(days)

    with pytest.raises(RuntimeError):
        run_backfill(log, table, *span, failing, days_per_job=2, **options)
    assert rollup(log) == [("failed", 2, 20)]
    run_backfill(log, table, *span, compute, **options)
    assert [d.day for d in calls[-1]] == [3, 4, 5]
    assert rollup(log) == [("completed", 3, 30), ("failed", 2, 20)]


def test_backfill_empties_days_without_rows(backfill):
    log, table, span, compute, _, options = backfill
    run_backfill(log, table, *span, compute, **options)
    table.replace_days(compute([date(2026, 4, 1)]), [date(2026, 4, 1), date(2026, 4, 2)])
    assert [r["event_date"].day for r in table.partition_counts().collect()] == [1, 3, 4, 5]
    table.replace_days(compute([date(2026, 4, 1)]).limit(0), [date(2026, 4, d) for d in (1, 3)])
    assert [d.day for d in table.days()] == [4, 5]


def test_daily_activity_reads_only_days_that_count(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(
        [("u", "m", 1.0, day(1))], "user_id string, merchant_id string, amount double, event_ts timestamp"
    ).write.parquet(path)
    plan = explained(user_activity_by_day(spark.read.parquet(path), [date(2026, 5, 10)]))
    assert "GreaterThanOrEqual(event_ts,2026-04-10" in plan
    assert "LessThanOrEqual(event_ts,2026-05-10" in plan
