from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, day, explained
from tidemark.functions.packing import MISSING, PRESENT, STALE
from tidemark.operators import asof
from tidemark.operators.governance import erase_entities
from tidemark.operators.quality import Expectation, QualityError
from tidemark.plans.materialize import materialize_view
from tidemark.plans.stored_reports import stored_freshness, stored_null_rates, stored_volumes
from tidemark.plans.training import build_from_tables, save_training_set, service_training_set
from tidemark.plans.views import VIEWS, FeatureView
from tidemark.queries import QUERIES, common
from tidemark.sources.commits import CommitLog, WriteConflict
from tidemark.sources.feature_table import (
    FeatureTable,
    latest_per_entity,
    partition_days,
    time_bounds,
    with_partition,
)
from tidemark.sources.latest_table import LatestTable, lookup, prewarm

ROWS = "entity_id string, event_ts timestamp, v long, created_ts timestamp"


@pytest.fixture
def table(spark, tmp_path):
    return FeatureTable(spark, str(tmp_path), "numbers_v1", "v long")


@pytest.fixture
def online(spark, tmp_path):
    return LatestTable(spark, str(tmp_path / "online"), "numbers_v1", "v long", buckets=4)


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROWS)


def stored(table):
    got = table.read_range(day(1, month=1), day(31, month=12)).collect()
    return sorted((r["entity_id"], r["event_ts"].day, r["v"]) for r in got)


def test_partition_is_the_utc_day(spark):
    df = with_partition(spark.createDataFrame([(day(1, hours=23),)], "event_ts timestamp"))
    assert df.first()["event_date"] == date(2026, 5, 1)


def test_partition_days_include_both_ends(spark):
    days = partition_days(spark, date(2026, 5, 1), date(2026, 5, 4)).collect()
    assert [r[0].day for r in days] == [1, 2, 3, 4]


def test_upsert_keeps_the_newest_write_and_is_idempotent(spark, table):
    first = rows(
        spark,
        ("a", day(1), 1, day(1)),
        ("a", day(1), 2, day(2)),
        ("b", day(2), 3, day(2)),
        ("c", day(3), 4, day(3)),
    )
    result = table.upsert(first)
    assert result.rows_written == 3 and [d.day for d in result.partitions] == [1, 2, 3]
    change = rows(spark, ("a", day(1), 9, day(1)), ("b", day(2), 8, day(2)), ("d", day(2), 5, day(2)))
    for _ in range(2):
        assert table.upsert(change).rows_written == 3
        assert stored(table) == [("a", 1, 2), ("b", 2, 8), ("c", 3, 4), ("d", 2, 5)]
    assert table.upsert(rows(spark).limit(0)).rows_written == 0
    assert table.partition_counts().collect()[1]["rows"] == 2


def test_upsert_refuses_rows_without_time(spark, table):
    with pytest.raises(ValueError):
        table.upsert(rows(spark, ("a", None, 1, day(1))))


def test_range_is_half_open_and_reads_only_its_days(spark, table):
    table.upsert(rows(spark, *[("a", day(d), d, day(d)) for d in range(1, 11)]))
    part = table.read_range(day(3), day(5))
    assert sorted(r["v"] for r in part.collect()) == [3, 4]
    assert sorted(r["v"] for r in table.read_range(day(3), day(5), closed=True).collect()) == [3, 4, 5]
    plan = explained(part.select("v"))
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2026-05-03" in plan
    assert "PushedFilters: [IsNotNull(event_ts)" in plan
    assert "ReadSchema: struct<event_ts:timestamp,v:bigint>" in plan


def test_missing_table_reads_as_empty(spark, table):
    assert table.read_range(day(1), day(2)).count() == 0
    assert table.latest_event_ts().first()[0] is None


def test_latest_event_ts_reads_one_day(spark, table):
    table.upsert(rows(spark, *[("a", day(d), d, day(d)) for d in range(1, 6)]))
    newest = table.latest_event_ts()
    assert newest.first()[0].day == 5
    assert "2026-05-05" in explained(newest).split("PartitionFilters")[1][:200]


def test_retention_drops_whole_days(spark, table):
    table.upsert(rows(spark, *[("a", day(d), d, day(d)) for d in range(1, 11)]))
    dropped = table.expire(date(2026, 5, 10), days=3)
    assert len(dropped) == 6 and [r[2] for r in stored(table)] == [7, 8, 9, 10]
    assert table.expire(date(2026, 5, 10), days=3) == []


def test_past_versions_can_be_read_back(spark, table):
    table.append_versions(rows(spark, ("a", day(1), 1, day(1)), ("a", day(1), 2, day(9))))
    seen = table.known_at(day(5), day(1), day(2)).collect()
    assert [r["v"] for r in seen] == [1]


def test_as_of_scans_the_ttl_before_the_first_row(spark, table):
    table.upsert(rows(spark, *[("a", day(d), d, day(d)) for d in range(1, 21)]))
    spine = spark.createDataFrame([("a", day(10, hours=5)), ("a", day(12))], "entity_id string, event_ts timestamp")
    out = table.as_of(spine, ttl=timedelta(days=2))
    assert sorted(r["v"] for r in out.collect()) == [10, 12]
    plan = explained(out)
    assert "2026-05-08" in plan and "2026-05-12" in plan
    empty = table.as_of(spine.limit(0), ttl=timedelta(days=2))
    assert empty.count() == 0


def test_training_set_from_tables_uses_each_views_ttl(spark, table):
    table.upsert(rows(spark, ("a", day(1), 1, day(1))))
    spine = spark.createDataFrame([("a", day(3)), ("a", day(9))], "entity_id string, event_ts timestamp")
    view = FeatureView("numbers_v1", ("entity_id",), "v long", timedelta(days=5))
    made = build_from_tables(spine, {"numbers_v1": table}, {"numbers_v1": view})
    assert sorted((r["event_ts"].day, r["v"]) for r in made.rows.collect()) == [(3, 1), (9, None)]


def test_time_bounds_of_nothing(spark):
    assert time_bounds(spark.createDataFrame([], "event_ts timestamp")) is None


def test_latest_row_per_entity(spark):
    df = rows(
        spark, ("a", day(1), 1, day(1)), ("a", day(2), 2, day(2)), ("a", day(2), 3, day(3)),
        (None, day(5), 4, day(5)),
    )
    assert [(r["entity_id"], r["v"]) for r in latest_per_entity(df).collect()] == [("a", 3)]


def latest(spark, **values):
    data = [(k, v, day(1)) for k, v in values.items()]
    return spark.createDataFrame(data, "entity_id string, v long, event_ts timestamp")


def test_read_keeps_request_rows_and_hides_expired(spark, online):
    online.write(latest(spark, u1=1, u3=3), day(1), timedelta(hours=1))
    ask = spark.createDataFrame([(0, "u1"), (1, "u2"), (2, "u3")], "n long, entity_id string")
    at_once = {r["n"]: r["v"] for r in online.read(ask, day(1)).collect()}
    assert at_once == {0: 1, 1: None, 2: 3}
    assert {r["v"] for r in online.read(ask, day(1, hours=1)).collect()} == {None}


def test_older_windows_do_not_replace_newer(spark, online):
    newer = latest(spark, u=2).withColumn("event_ts", F.lit(day(3)))
    online.write(newer, day(3), timedelta(days=1), newest_wins=True)
    online.write(latest(spark, u=1), day(4), timedelta(days=1), newest_wins=True)
    assert [r["v"] for r in online.rows().collect()] == [2]
    online.write(latest(spark, u=1), day(4), timedelta(days=1))
    assert [r["v"] for r in online.rows().collect()] == [1]


def test_ttl_is_extended_for_live_keys_only(spark, online):
    online.write(latest(spark, u1=1), day(1), timedelta(seconds=60))
    ask = latest(spark, u1=0, u2=0)
    hour = timedelta(hours=1)
    assert online.extend_ttl(ask, day(1, seconds=30), hour).first()["extended"] == 1
    assert online.extend_ttl(ask, day(1, hours=2), hour).first()["extended"] == 0
    assert online.rows().count() == 1


def test_prewarm_only_for_an_imminent_peak(spark, online):
    online.write(latest(spark, u1=1, u2=2), day(1), timedelta(hours=1))
    hot = spark.createDataFrame([("numbers_v1", "u1")], "feature_view string, entity_id string")
    peaks = lambda **at: spark.createDataFrame(
        [("numbers_v1", day(1, **at))], "feature_view string, start_ts timestamp"
    )
    assert prewarm([online], peaks(hours=5), hot, day(1)).count() == 0
    warmed = prewarm([online], peaks(minutes=10), hot, day(1)).collect()
    assert [tuple(r) for r in warmed] == [("numbers_v1", 1)]
    expiry = {r["entity_id"]: r["expires_at"] for r in online.rows().collect()}
    assert expiry["u1"] - expiry["u2"] == timedelta(hours=5)


def test_lookup_statuses_and_services(spark, online, tmp_path):
    online.write(latest(spark, a=1), day(1), timedelta(hours=1))
    other = LatestTable(spark, str(tmp_path / "online"), "more_v1", "v long, w string")
    values = spark.createDataFrame(
        [("m|a", 7, "x", day(1))], "entity_id string, v long, w string, event_ts timestamp"
    )
    other.write(values, day(1), timedelta(days=1))
    ask = spark.createDataFrame(
        [(1, "a", "m"), (2, "a", "n"), (3, "b", "m")], "n long, user_id string, merchant_id string"
    )
    tables = [(online, ["user_id"]), (other, ["user_id", "merchant_id"])]
    got = {r["n"]: r for r in lookup(ask, tables, day(1)).collect()}
    assert [got[n]["v"] for n in (1, 2, 3)] == [7, 1, None]
    assert [got[n]["numbers_v1__status"] for n in (1, 2, 3)] == [PRESENT, PRESENT, MISSING]
    assert [got[n]["more_v1__status"] for n in (1, 2, 3)] == [PRESENT, MISSING, MISSING]
    later = {r["n"]: r for r in lookup(ask, tables, day(1, hours=3)).collect()}
    assert later[2]["numbers_v1__status"] == STALE and later[2]["v"] is None
    services = {"s": ("more_v1",)}
    some = lookup(ask, tables, day(1), services=services, service="s")
    assert "numbers_v1__status" not in some.columns
    assert lookup(ask, tables, day(1), services=services, service="t").columns == ask.columns


def test_materialize_reruns_and_gate(spark, table, online):
    table.upsert(
        rows(spark, ("a", day(1), 1, day(1)), ("a", day(2), 2, day(2)), ("b", day(9), 3, day(9)))
    )
    options = {"now": day(10), "ttl": timedelta(days=1)}
    for _ in range(2):
        done = materialize_view(table, online, day(1), day(5), **options).first()
        assert tuple(done) == ("numbers_v1", 1)
    assert [(r["entity_id"], r["v"]) for r in online.rows().collect()] == [("a", 2)]
    empty = materialize_view(table, online, day(20), day(25), **{**options, "now": day(11)}).first()
    assert empty["rows_written"] == 0
    gate = [Expectation("v", "between", {"min": 0, "max": 2})]
    with pytest.raises(QualityError):
        materialize_view(table, online, day(1), day(20), gate=gate, **options)
    assert online.rows().count() == 1


def test_erasure_reaches_every_store_and_composite_ids(spark, table, online, tmp_path):
    pairs = FeatureTable(spark, str(tmp_path), "pairs_v1", "v long")
    table.upsert(
        rows(spark, ("u1", day(1), 1, day(1)), ("u2", day(1), 2, day(1)), ("u1", day(2), 3, day(2)))
    )
    pairs.upsert(
        rows(
            spark, ("m|u1", day(1), 1, day(1)), ("m|u12", day(1), 2, day(1)),
            ("m\\|u1|u2", day(1), 3, day(1)),
        )
    )
    online.write(latest(spark, u1=1, u2=2), day(3), timedelta(days=1))

    def run(moment):
        ask = spark.createDataFrame([("u1",), ("u1",), ("nobody",)], "entity_id string")
        audit = erase_entities(
            spark,
            ask,
            offline=[table, pairs],
            online=[online],
            audit_folder=str(tmp_path / "audit"),
            erased_at=moment,
        )
        return {
            (r["entity_id"], r["store"], r["feature_view"]): r["rows_deleted"]
            for r in audit.collect()
        }

    first = run(day(5))
    assert first["u1", "offline", "numbers_v1"] == 2
    assert first["u1", "offline", "pairs_v1"] == 1
    assert first["u1", "online", "numbers_v1"] == 1
    assert first["nobody", "offline", "numbers_v1"] == 0
    assert stored(table) == [("u2", 1, 2)]
    assert [r[0] for r in stored(pairs)] == ["m\\|u1|u2", "m|u12"]
    assert [r["entity_id"] for r in online.rows().collect()] == ["u2"]
    assert set(run(day(6)).values()) == {0}
    assert spark.read.parquet(str(tmp_path / "audit/*/audit")).count() == 12


def test_windows_with_one_write_time_are_counted_apart(spark, table, online):
    table.upsert(
        rows(spark, ("a", day(1), 1, day(1)), ("b", day(2), 2, day(2)), ("c", day(9), 3, day(9)))
    )
    counts = [
        materialize_view(table, online, day(a), day(b), now=day(10), ttl=timedelta(days=1)).first()[1]
        for a, b in ((1, 5), (8, 12), (20, 25))
    ]
    assert counts == [2, 1, 0]


def test_an_erasure_that_failed_half_way_keeps_its_record(spark, table, tmp_path, monkeypatch):
    other = FeatureTable(spark, str(tmp_path), "other_v1", "v long")
    for t in (table, other):
        t.upsert(rows(spark, ("u1", day(1), 1, day(1)), ("u2", day(1), 2, day(1))))
    ask = spark.createDataFrame([("u1",)], "entity_id string")
    options = {"offline": [table, other], "online": [], "audit_folder": str(tmp_path / "audit")}
    erase = FeatureTable.erase

    def failing(self, targets):
        if self.name == "other_v1":
            raise RuntimeError("lost")
        erase(self, targets)

    monkeypatch.setattr(FeatureTable, "erase", failing)
    with pytest.raises(RuntimeError):
        erase_entities(spark, ask, erased_at=day(5), **options)
    monkeypatch.undo()
    audit = erase_entities(spark, ask, erased_at=day(5), **options)
    assert sorted(r["rows_deleted"] for r in audit.collect()) == [1, 1]
    assert [r[0] for r in stored(other)] == ["u2"]
    more = spark.createDataFrame([("u2",)], "entity_id string")
    audit = erase_entities(spark, more, erased_at=day(5), **options)
    assert sorted(r["rows_deleted"] for r in audit.collect()) == [1, 1]
    assert spark.read.parquet(str(tmp_path / "audit/*/audit")).count() == 4
    assert not list((tmp_path / "audit").glob("*/targets"))


def test_a_service_joins_each_view_on_its_own_keys(spark, tmp_path):
    tables = {}
    for name, ids in (("user_features_v2", "u1"), ("merchant_features_v1", "m1")):
        features = ", ".join(VIEWS[name].features.split(", ")[:2])
        tables[name] = FeatureTable(spark, str(tmp_path), name, features)
        columns = tables[name].features
        for version, at in ((1, day(1)), (2, day(4))):
            row = spark.createDataFrame([(ids, day(1), at)], "entity_id string, event_ts timestamp, created_ts timestamp")
            row = row.withColumns({c: F.lit(version).cast("double" if "avg" in c else "long") for c in columns})
            tables[name].append_versions(row)
    spine = spark.createDataFrame(
        [("u1", "m1", day(5)), ("u1", "m2", day(5)), (None, "m1", day(5))],
        "user_id string, merchant_id string, event_ts timestamp",
    )
    made = service_training_set(spine, "underwriting_v1", tables)
    age, shop = "account_age_days", "merchant_age_days"
    assert made.versions == {"user_features_v2": 2, "merchant_features_v1": 1}
    assert sorted((r[age] or 0, r[shop] or 0) for r in made.rows.collect()) == [(0, 2), (2, 0), (2, 2)]
    past = service_training_set(spine, "underwriting_v1", tables, known_at=day(2))
    assert {r[age] for r in past.rows.collect()} == {1, None}
    path = save_training_set(made, str(tmp_path / "sets"), service="underwriting_v1", snapshot="s1")
    again = save_training_set(past, str(tmp_path / "sets"), service="underwriting_v1", snapshot="s1")
    assert path == again and {r[age] for r in spark.read.parquet(path).collect()} == {2, None}
    noted = spark.read.parquet(str(tmp_path / "sets/underwriting_v1/s1/manifest")).collect()
    assert {(r["pinned"], r["row_count"]) for r in noted} == {("user_features_v2:v2", 3), ("merchant_features_v1:v1", 3)}
    with pytest.raises(LookupError):
        service_training_set(spine, "none", tables)


def test_one_changed_key_writes_one_row(spark, tmp_path):
    made = LatestTable(spark, str(tmp_path), "v", "v long", buckets=8)
    made.write(latest(spark, **{f"u{i}": i for i in range(100)}), day(1), timedelta(days=9))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("v/run=*/*.parquet")}
    before = files()
    again = LatestTable(spark, str(tmp_path), "v", "v long")
    assert again.buckets == 8
    again.write(latest(spark, u7=700), day(2), timedelta(days=9))
    assert before.items() <= files().items()
    added = [p for p in files() if p not in before]
    assert spark.read.parquet(*added).count() == 1
    want = {f"u{i}": i for i in range(100)} | {"u7": 700}
    assert {r["entity_id"]: r["v"] for r in again.rows().collect()} == want
    again.compact()
    assert again.log.newest()[1]["deltas"] == []
    assert {r["entity_id"]: r["v"] for r in again.rows().collect()} == want
    with pytest.raises(ValueError):
        LatestTable(spark, str(tmp_path), "v", "v long", buckets=4)


def test_changes_merge_in_order_across_compactions(spark, tmp_path):
    """Random writes, extensions and deletions against a dict, compacted after every third change."""
    rng = random.Random(3)
    made = LatestTable(spark, str(tmp_path), "v", "v long", buckets=2, compact_after=3)
    want, minute = {}, timedelta(minutes=1)
    for turn in range(12):
        now = day(1, hours=turn)
        some = rng.sample("abcdef", 3)
        kind = rng.choice(["put", "newest", "extend", "erase"])
        ask = spark.createDataFrame([(k,) for k in some], "entity_id string")
        if kind == "extend":
            alive = [k for k in some if k in want and want[k][2] > now]
            assert made.extend_ttl(ask, now, 90 * minute).first()["extended"] == len(alive)
            for k in alive:
                want[k] = (*want[k][:2], now + 90 * minute)
        elif kind == "erase" and turn % 4 == 3:
            made.erase(ask.withColumn("requested", F.col("entity_id")))
            want = {k: v for k, v in want.items() if k not in some}
        else:
            given = [(k, turn, day(rng.randrange(1, 9))) for k in some]
            df = spark.createDataFrame(given, "entity_id string, v long, event_ts timestamp")
            made.write(df, now, 90 * minute, newest_wins=kind == "newest")
            for k, v, at in given:
                if kind != "newest" or k not in want or at >= want[k][1]:
                    want[k] = (v, at, now + 90 * minute)
        got = {r["entity_id"]: (r["v"], r["event_ts"], r["expires_at"]) for r in made.rows().collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert {k: v[2].timestamp() for k, v in got.items()} == {k: v[2].timestamp() for k, v in want.items()}
        assert len(made.log.newest()[1].get("deltas", [])) < 3
    assert len(list(tmp_path.glob("v/run=*"))) <= 12


def test_a_repeated_write_changes_nothing(spark, online):
    for value in (1, 2):
        online.write(latest(spark, u=value), day(1), timedelta(days=1), token="stream:7")
    assert [r["v"] for r in online.rows().collect()] == [1] and len(online.log.versions()) == 1


def test_erased_entities_are_in_no_file(spark, online, tmp_path):
    online.write(latest(spark, u1=1, u2=2), day(1), timedelta(days=1))
    online.write(latest(spark, u1=3), day(1), timedelta(days=1))
    online.erase(spark.createDataFrame([("u1", "u1")], "entity_id string, requested string"))
    found = spark.read.parquet(*[str(p) for p in tmp_path.glob("online/numbers_v1/run=*/*.parquet")])
    assert {r["entity_id"] for r in found.collect()} == {"u2"}


def test_readers_keep_their_version_and_snapshots_can_be_read(spark, tmp_path):
    moments = iter(range(1, 20))
    made = FeatureTable(spark, str(tmp_path), "t", "v long", clock=lambda: day(next(moments)), keep=3)
    made.upsert(rows(spark, ("a", day(1), 1, day(1)), ("b", day(2), 2, day(1))))
    before = made.read_range(day(1), day(9))
    made.upsert(rows(spark, ("a", day(1), 10, day(2)), ("c", day(3), 3, day(2))))
    values = lambda df: sorted(r["v"] for r in df.collect())
    assert values(before) == [1, 2] and values(made.read_range(day(1), day(9))) == [2, 3, 10]
    at = lambda n, **more: values(made.snapshot(day(n, **more), day(1), day(9)))
    assert at(1) == [1, 2] and at(1, hours=23) == [1, 2] and at(2) == [2, 3, 10] and made.snapshot(day(1, month=4), day(1), day(9)).isEmpty()
    made.replace_days(rows(spark, ("z", day(3), 30, day(3))), [date(2026, 5, 3), date(2026, 5, 2)])
    assert at(2) == [2, 3, 10] and at(3) == [10, 30]
    made.erase(spark.createDataFrame([("a",)], "entity_id string"))
    assert at(4) == [30] and at(3) == [30]
    assert len(made.log.versions()) == 3 and at(1) == []


def test_colliding_writers_lose_nothing(spark, tmp_path, monkeypatch):
    first, other = (FeatureTable(spark, str(tmp_path), "t", "v long") for _ in range(2))
    first.upsert(rows(spark, ("a", day(1), 1, day(1))))
    newest = CommitLog.newest
    turns = []

    def late(self):
        found = newest(self)
        if self is first.log and not turns:
            turns.append(1)
            other.upsert(rows(spark, ("b", day(1), 2, day(1))))
        return found

    monkeypatch.setattr(CommitLog, "newest", late)
    first.upsert(rows(spark, ("c", day(1), 3, day(1))))
    monkeypatch.undo()
    assert stored(first) == [("a", 1, 1), ("b", 1, 2), ("c", 1, 3)]
    with pytest.raises(WriteConflict):
        first.log.commit(1, {})


def test_a_version_cut_short_is_not_read(spark, tmp_path):
    made = FeatureTable(spark, str(tmp_path), "t", "v long")
    made.upsert(rows(spark, ("a", day(1), 1, day(1))))
    (tmp_path / "t/_commits/000000000002.json").write_text('{"days": {"20')
    assert stored(made) == [("a", 1, 1)]
    made.upsert(rows(spark, ("b", day(1), 2, day(1))))
    assert stored(made) == [("a", 1, 1), ("b", 1, 2)] and made.log.versions() == [1, 2, 3]


def test_reports_over_stored_views_read_no_files(spark, table, tmp_path):
    other = FeatureTable(spark, str(tmp_path), "more_v1", "x double, w string")
    more = "entity_id string, event_ts timestamp, x double, w string, created_ts timestamp"
    nan = float("nan")
    data = [("a", day(1), 1.0, None, day(1)), ("b", day(1), nan, "s", day(1)), ("c", day(2), None, "s", day(1))]
    other.append_versions(spark.createDataFrame(data, more))
    other.append_versions(spark.createDataFrame(data[:1], more))
    table.upsert(rows(spark, ("a", day(1), 1, day(1)), ("b", day(1), None, day(1)), ("b", day(4), None, day(1))))
    table.upsert(rows(spark, ("a", day(1), None, day(2)), ("c", day(1, hours=3), 5, day(2))))
    table.erase(spark.createDataFrame([("b",)], "entity_id string"))
    counts = {(r["feature_view"], r["event_date"].day): r["rows"] for r in stored_volumes([table, other]).collect()}
    assert counts == {("numbers_v1", 1): 2, ("more_v1", 1): 3, ("more_v1", 2): 1}
    report = stored_null_rates([table, other])
    assert "Scan parquet" not in explained(report)
    rates = {(r["feature_view"], r["feature"]): r["null_rate"] for r in report.collect()}
    assert rates == {("numbers_v1", "v"): 0.5, ("more_v1", "x"): 0.5, ("more_v1", "w"): 0.5}
    first = stored_null_rates([other], date(2026, 5, 2), date(2026, 5, 9))
    assert {r["feature"]: r["null_rate"] for r in first.collect()} == {"x": 1.0, "w": 0.0}
    slas = spark.createDataFrame([("numbers_v1", "1h"), ("more_v1", "9d"), ("none", "1d")], "feature_view string, sla string")
    aged = {r["feature_view"]: (r["age_seconds"], r["breached"]) for r in stored_freshness([table, other], slas, day(2)).collect()}
    assert aged == {"numbers_v1": (21 * 3600.0, True), "more_v1": (0.0, False), "none": (float("inf"), True)}
    assert table.upsert(rows(spark, ("z", day(8), 1, day(8)))).rows_written == 1


def test_statistics_spare_the_planning_of_views(spark, table, monkeypatch):
    """With the table's bounds only the spine is counted; a key that may be heavy is planned for as before."""
    table.upsert(rows(spark, *[("a", day(d), d, day(d)) for d in range(1, 11)], *[("b", day(1, hours=h), h, day(1)) for h in range(9)]))
    assert table.rows_per_entity() == 18 and table.rows_per_entity(date(2026, 5, 2), date(2026, 5, 4)) == 3
    spine = spark.createDataFrame([("a", day(10, hours=5)), ("a", day(3)), ("b", day(2))], "entity_id string, event_ts timestamp")
    planned = []
    plan = asof.plan_slices
    monkeypatch.setattr(asof, "plan_slices", lambda *args: planned.append(1) or plan(*args))
    values = lambda out: sorted((r["entity_id"], r["event_ts"].day, r["v"]) for r in out.collect())
    want = [("a", 3, 3), ("a", 10, 10), ("b", 2, 8)]
    assert values(table.as_of(spine)) == want and not planned
    monkeypatch.setattr(asof, "ROWS_PER_SLICE", 5)
    assert values(table.as_of(spine)) == want and planned
    few = table.as_of(spine.where("entity_id = 'b'"), spine_keys_only=True)
    assert values(few) == [("b", 2, 8)] and "LeftSemi" in explained(few)


@pytest.mark.parametrize(
    "name", ["materialize_views", "training_service", "user_features_tiles", "lookup_vectors", "online_lookup", "gated_materialize"]
)
def test_order_lines_are_joined_once(spark, monkeypatch, name):
    joined, join = [], common.line_transactions
    monkeypatch.setattr(common, "line_transactions", lambda *args: joined.append(1) or join(*args))
    QUERIES[name](spark, SMALL)
    assert len(joined) == 1


def test_stored_lines_are_the_lines(spark):
    stored, given = common.stored_lines(spark, SMALL), common.lines(spark, SMALL)
    assert stored.schema.simpleString() == given.schema.simpleString()
    assert sorted(map(str, stored.collect())) == sorted(map(str, given.collect()))
