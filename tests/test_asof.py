from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import day, explained, shuffles
from tidemark.operators import slices
from tidemark.operators.asof import (
    AsOfView,
    leakage_audit,
    point_in_time_join,
    point_in_time_join_views,
)
from tidemark.plans.training import build_training_set, manifest

SPINE = "entity_id string, event_ts timestamp"
FEATURE = "entity_id string, event_ts timestamp, v long"


def join(spark, spine, features, schema=FEATURE, **options):
    return point_in_time_join(
        spark.createDataFrame(spine, SPINE), spark.createDataFrame(features, schema), **options
    )


def values(df, column="v"):
    return [r[column] for r in df.orderBy("entity_id", "event_ts").collect()]


def test_a_nearer_future_value_is_never_taken(spark):
    out = join(spark, [("u1", day(10))], [("u1", day(1), 100), ("u1", day(11), 999)])
    assert values(out) == [100]


def test_a_value_at_the_same_instant_counts(spark):
    assert values(join(spark, [("u1", day(10))], [("u1", day(10), 7)])) == [7]


def test_stale_values_become_null_and_the_limit_is_inclusive(spark):
    week = timedelta(days=7)
    assert values(join(spark, [("u1", day(30))], [("u1", day(1), 5)], ttl=week)) == [None]
    assert values(join(spark, [("u1", day(8))], [("u1", day(1), 5)], ttl=week)) == [5]
    over = [("u1", day(8, microseconds=1))]
    assert values(join(spark, over, [("u1", day(1), 5)], ttl=week)) == [None]


def test_only_future_values_give_null(spark):
    assert values(join(spark, [("u1", day(1))], [("u1", day(5), 5)])) == [None]


def test_composite_ids_stay_apart(spark):
    spine = [("u1|m1", day(10)), ("u1|m2", day(10))]
    features = [("u1|m1", day(9), 11), ("u1|m1", day(20), 999), ("u1|m2", day(5), 22)]
    assert values(join(spark, spine, features)) == [11, 22]


def test_the_most_recent_past_value_wins(spark):
    features = [("u1", day(d), d) for d in (1, 5, 9)]
    assert values(join(spark, [("u1", day(10))], features)) == [9]


def test_an_empty_spine_stays_empty(spark):
    out = join(spark, [], [("u1", day(1), 1)])
    assert out.columns == ["entity_id", "event_ts", "v"] and out.count() == 0


def test_no_features_at_all(spark):
    assert values(join(spark, [("u1", day(1))], [])) == [None]


def test_entities_do_not_mix(spark):
    out = join(spark, [("u1", day(10)), ("u2", day(10))], [("u1", day(9), 91), ("u2", day(8), 82)])
    assert values(out) == [91, 82]


def test_training_example_reads_the_value_of_the_day(spark):
    """The value exactly at the last spine row's time is found."""
    features = [("u1", day(1) + timedelta(days=d), d) for d in range(30)]
    assert values(join(spark, [("u1", day(10)), ("u1", day(20))], features)) == [9, 19]


def test_ties_go_to_the_last_written_then_to_the_greatest_value(spark):
    schema = "entity_id string, event_ts timestamp, created_ts timestamp, v long"
    rows = [("u1", day(9), day(9), 3), ("u1", day(9), day(10), 1), ("u1", day(9), None, 9)]
    assert values(join(spark, [("u1", day(20))], rows, schema)) == [1]
    rows = [("u1", day(9), day(9), 3), ("u1", day(9), day(9), 8), ("u1", day(9), day(9), 5)]
    assert values(join(spark, [("u1", day(20))], rows, schema)) == [8]


def test_a_null_in_the_chosen_row_stays_null(spark):
    out = join(spark, [("u1", day(9))], [("u1", day(1), 1), ("u1", day(2), None)])
    assert values(out) == [None]


def test_duplicate_and_incomplete_spine_rows_are_kept(spark):
    spine = [("u1", day(9)), ("u1", day(9)), (None, day(9)), ("u1", None)]
    out = join(spark, spine, [("u1", day(1), 1), (None, day(1), 5)])
    assert sorted(out.collect(), key=str) == sorted(
        [(*r, 1 if None not in r else None) for r in _naive(spine)], key=str
    )


def _naive(rows):
    return [(k, t and t.astimezone().replace(tzinfo=None)) for k, t in rows]


def test_shared_column_names_are_prefixed_and_the_spine_column_survives(spark):
    spine = spark.createDataFrame([("u1", day(30), 4)], SPINE + ", v long")
    features = spark.createDataFrame([("u1", day(1), 5)], FEATURE)
    out = point_in_time_join(spine, features, ttl=timedelta(days=1)).first()
    assert (out["v"], out["features__v"]) == (4, None)


def _brute(spine, features, ttl):
    out = []
    for key, ts in spine:
        past = [f for f in features if f[0] == key and f[1] <= ts]
        best = max(past, key=lambda f: (f[1], f[2], f[3]), default=None)
        fresh = best is not None and (ttl is None or ts - best[1] <= ttl)
        out.append((key, ts, best[3] if fresh else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_slice", [None, 1, 7])
@pytest.mark.parametrize("ttl", [None, timedelta(hours=30)])
def test_against_brute_force_with_heavy_keys_and_crowded_instants(spark, rows_per_slice, ttl):
    """A third of the rows on one key, and a third of those on one instant, in copies."""
    rng = random.Random(5)
    base = datetime(2026, 5, 1)

    def moment(key):
        hot = key == "hot" and rng.random() < 0.35
        return base + timedelta(hours=100 if hot else rng.randrange(300))

    keys = [rng.choice(["hot", "hot", "a", "b", "c", "d"]) for _ in range(700)]
    spine = [(k, moment(k)) for k in keys[:400]]
    features = [
        (k, moment(k), base + timedelta(hours=rng.randrange(50)), rng.randrange(5))
        for k in keys[400:]
    ]
    schema = "entity_id string, event_ts timestamp_ntz, created_ts timestamp_ntz, v long"
    out = point_in_time_join(
        spark.createDataFrame(spine, "entity_id string, event_ts timestamp_ntz"),
        spark.createDataFrame(features, schema),
        ttl=ttl,
        rows_per_slice=rows_per_slice,
    )
    got = sorted([(r["entity_id"], r["event_ts"], r["v"]) for r in out.collect()], key=str)
    assert got == _brute(spine, features, ttl)


def test_light_keys_take_one_shuffle_for_several_views(spark, tmp_path):
    rows = spark.range(1000).select(
        (F.col("id") % 50).cast("string").alias("entity_id"),
        F.timestamp_seconds("id").alias("event_ts"),
        F.col("id").alias("v"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    views = [
        AsOfView(n, stored.withColumnRenamed("v", n), created_ts=None) for n in ("a", "b", "c")
    ]
    out = point_in_time_join_views(stored.select("entity_id", "event_ts"), views)
    assert shuffles(out) == 1
    plan = explained(out)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cut_points_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(slices, "MAX_SLICES", 20)
    rows = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    found = slices.plan_slices(rows, ["k"], "at", rows_per_slice=1)
    cuts = found.table.collect()
    assert len(cuts) == 3 and sum(len(r["_cuts"]) for r in cuts) <= 40


def test_slices_spread_a_heavy_key_evenly(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at")
    )
    found = slices.plan_slices(rows, ["k"], "at", rows_per_slice=500)
    sizes = found.tag(rows, "at").where("_upto IS NOT NULL").groupBy("_upto").count()
    biggest = sizes.agg(F.max("count")).first()[0]
    assert found.table.count() == 1 and biggest <= 1000


def test_no_heavy_key_means_no_cuts(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("at"))
    assert not slices.plan_slices(rows, ["k"], "at", rows_per_slice=10).any_heavy


def test_audit_counts_matches_and_finds_no_leak(spark):
    out = join(
        spark,
        [("u1", day(9)), ("u2", day(9))],
        [("u1", day(1), 1), ("u1", day(10), 2)],
        matched_ts="seen",
    )
    audit = leakage_audit(out, event_ts="event_ts", matched_ts="seen").first()
    assert tuple(audit) == (2, 1, 0)


def test_a_spine_that_lacks_columns_is_refused(spark):
    spine = spark.createDataFrame([("u1", day(1))], SPINE)
    view = AsOfView("m", spine.withColumn("merchant_id", F.lit("m")), ("merchant_id",))
    with pytest.raises(ValueError, match="merchant_id .*event_ts .*outcome"):
        build_training_set(spine.drop("event_ts"), [view], label="outcome")
    with pytest.raises(ValueError):
        build_training_set(spine, [])


def test_versions_default_to_one_and_reach_the_manifest(spark):
    spine = spark.createDataFrame([("u1", day(5)), ("u2", day(5))], SPINE)
    view = AsOfView("a", spark.createDataFrame([("u1", day(1), 1)], FEATURE), created_ts=None)
    other = AsOfView("b", spark.createDataFrame([("u1", day(1), 2)], FEATURE), created_ts=None)
    made = build_training_set(spine, [view, other], versions={"b": 3})
    assert made.versions == {"a": 1, "b": 3}
    rows = manifest(made, service="s", snapshot="x").orderBy("pinned").collect()
    assert [(r["pinned"], r["row_count"]) for r in rows] == [("a:v1", 2), ("b:v3", 2)]
    assert made.rows.columns == ["entity_id", "event_ts", "a__v", "b__v"]


@pytest.mark.parametrize("groups", range(1, 6))
def test_each_set_of_keys_takes_one_shuffle(spark, tmp_path, groups):
    columns = [f"k{i}" for i in range(groups)]
    spine = spark.range(50).select(
        "id", *[(F.col("id") % (i + 2)).alias(c) for i, c in enumerate(columns)],
        F.timestamp_seconds(F.col("id") * 100).alias("event_ts"),
    )
    spine = spine.withColumn("k0", F.when(F.col("id") % 7 > 0, F.col("k0")))
    spine.write.parquet(str(tmp_path / "spine"))
    spine = spark.read.parquet(str(tmp_path / "spine"))
    views = []
    for c in columns:
        spine.select(c, "event_ts", F.col("id").alias(f"v_{c}")).write.parquet(str(tmp_path / c))
        views.append(AsOfView(c, spark.read.parquet(str(tmp_path / c)), (c,), created_ts=None))
    out = point_in_time_join_views(spine, views)
    assert shuffles(out) == groups
    rows = out.collect()
    assert len(rows) == 50 and all(r["v_k0"] == r["id"] for r in rows if r["k0"] is not None)
    assert all(r["v_k0"] is None for r in rows if r["k0"] is None)


@pytest.mark.parametrize("rows_per_slice", [None, 2])
def test_maps_in_spines_and_views_are_carried(spark, rows_per_slice):
    """What a vector lookup returns can be joined: ties at one instant go to the greatest entries."""
    view = spark.createDataFrame(
        [("a", day(1), {"x": 1.0, "y": 2.0}), ("a", day(1), {"x": 3.0}), ("b", day(2), None), ("b", day(1), {"z": 1.0})],
        "entity_id string, event_ts timestamp, vector map<string,double>",
    )
    spine = spark.createDataFrame(
        [("a", day(3), {"s": 1}), ("b", day(3), None), (None, day(3), {}), ("c", None, {"t": 2})],
        "entity_id string, event_ts timestamp, statuses map<string,int>",
    )
    views = [AsOfView("v", view, created_ts=None, columns=("vector",))]
    out = point_in_time_join_views(spine, views, event_ts="event_ts", rows_per_slice=rows_per_slice)
    got = {r["entity_id"]: (r["statuses"], r["vector"]) for r in out.collect()}
    assert got == {"a": ({"s": 1}, {"x": 3.0}), "b": (None, None), None: ({}, None), "c": ({"t": 2}, None)}
