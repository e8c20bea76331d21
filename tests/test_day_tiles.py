from __future__ import annotations

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import explained
from tidemark.operators.batch_features import user_features
from tidemark.operators.day_tiles import DayTiles, user_features_from_tiles

SCHEMA = "user_id string, merchant_id string, amount double, event_ts timestamp, is_chargeback boolean"
FIRST = datetime(2026, 1, 1, tzinfo=timezone.utc)


def transactions(n=1500, seed=1):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["a", "b", "c", "d", None]),
            rng.choice(["m1", "m2", "m3", None]),
            rng.choice([None, 0.1, 12.34, 1e9, float("nan") if i % 500 == 0 else 5.5]),
            FIRST + timedelta(minutes=rng.randrange(150 * 1440)) if i % 100 else None,
            rng.random() < 0.2,
        )
        for i in range(n)
    ]


def compared(df):
    names = sorted(c for c in df.columns if c not in ("event_ts", "created_ts"))
    rows = df.where("entity_id IS NOT NULL").select(*names).collect()
    return sorted(tuple(f"{x:.12g}" if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("as_of", [datetime(2026, 5, 20), datetime(2026, 5, 20, 13, 37, 5), datetime(2026, 3, 31, 23, 59, 59)])
def test_tiles_equal_a_pass_over_everything(spark, tmp_path, as_of):
    as_of = as_of.replace(tzinfo=timezone.utc)
    df = spark.createDataFrame(transactions(), SCHEMA)
    tiles = DayTiles(spark, str(tmp_path), "user")
    days = [as_of.date() - timedelta(days=i) for i in range(0, 92)]
    # Half of the transactions come late: their days are made anew.
    tiles.update(df.where("amount > 5"), days[:40], as_of)
    tiles.update(df, days, as_of)
    tiles.see(df.where("amount > 5"), as_of)
    tiles.see(df, as_of)
    got = user_features_from_tiles(tiles, df, as_of)
    want = user_features(df.where("event_ts IS NOT NULL"), as_of)
    assert compared(got) == compared(want)


def test_tiles_read_ninety_days_and_updates_add_little(spark, tmp_path):
    df = spark.createDataFrame(transactions(), SCHEMA)
    tiles = DayTiles(spark, str(tmp_path / "t"), "user")
    as_of = datetime(2026, 5, 20, 6, tzinfo=timezone.utc)
    tiles.update(df, [FIRST.date() + timedelta(days=i) for i in range(139)], as_of)
    tiles.see(df, as_of)
    plan = explained(tiles.parts(df, as_of, (timedelta(days=30), timedelta(days=90))))
    line = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert re.findall(r"\d{4}-\d\d-\d\d", line)[:2] == ["2026-02-20", "2026-05-20"]
    before = len(tiles.first.log.versions())
    tiles.see(df, as_of)
    assert len(tiles.first.log.versions()) == before
    more = df.where("event_ts IS NOT NULL").limit(1).withColumn("user_id", F.lit("new"))
    tiles.see(more, as_of)
    newest = tiles.first.log.newest()[1]["deltas"][-1]
    assert spark.read.parquet(f"{tiles.first.path}/{newest}").count() == 1
