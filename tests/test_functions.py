from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.functions import keys, scalars
from tidemark.functions.ondemand import DerivedView, usable, with_derived
from tidemark.functions.packing import feature_vector, status_map
from tidemark.sources.streams import decode_transactions, kafka_options, kafka_transactions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def num(x):
    return F.lit(x).cast("double")


def test_scalars(spark):
    got = one(
        spark,
        z=scalars.amount_zscore(num(15), num(10), num(5)),
        z0=scalars.amount_zscore(num(10), num(10), num(0)),
        zn=scalars.amount_zscore(num(10), num(10), num(None)),
        cb=scalars.chargeback_rate(F.lit(2), F.lit(100)),
        cb0=scalars.chargeback_rate(F.lit(0), F.lit(0)),
        log0=scalars.log1p_amount(num(-5)),
        logn=scalars.log1p_amount(num(None)),
        v=scalars.velocity(F.lit(10), F.lit(300)),
        v0=scalars.velocity(F.lit(5), F.lit(0)),
        r=scalars.ratio_or_zero(num(6), num(3)),
        r0=scalars.ratio_or_zero(num(6), num(0)),
        rn=scalars.ratio_or_zero(num(None), num(3)),
        first=scalars.pair_is_first_txn(F.lit(1)),
    )
    assert got.asDict() == {
        "z": 1.0, "z0": 0.0, "zn": 0.0, "cb": 0.02, "cb0": 0.0, "log0": 0.0, "logn": None,
        "v": 2.0, "v0": 0.0, "r": 2.0, "r0": 0.0, "rn": 0.0, "first": 1,
    }


def test_cross_border(spark):
    text = lambda x: F.lit(x).cast("string")
    cases = [("US", "GB"), ("US", "US"), (None, "US"), ("US", ""), ("", "")]
    got = one(
        spark, **{f"c{i}": scalars.is_cross_border(text(a), text(b)) for i, (a, b) in enumerate(cases)}
    )
    assert list(got) == [1, 0, 0, 0, 0]


def test_ttl_predicate(spark):
    event, week = F.lit(day(10)), timedelta(days=7)
    got = one(
        spark,
        fresh=scalars.is_within_ttl(F.lit(day(9)), event, week),
        edge=scalars.is_within_ttl(F.lit(day(3)), event, week),
        old=scalars.is_within_ttl(F.lit(day(1, month=4)), event, week),
        future=scalars.is_within_ttl(F.lit(day(11)), event, week),
    )
    assert list(got) == [True, True, False, False]


def test_durations(spark):
    specs = {"30s": 30, "5m": 300, "24h": 86400, " 7d ": 604800, "2w": 1209600}
    rows = spark.createDataFrame([(s,) for s in [*specs, None]], "s string")
    got = [r[0] for r in rows.select(scalars.parse_duration(F.col("s"))).collect()]
    assert got == [*specs.values(), None]
    assert scalars.parse_duration_text("2w") == timedelta(days=14)
    for bad in ("soon", "5x", "h", "-5m", "1.5h"):
        with pytest.raises(ValueError):
            scalars.parse_duration_text(bad)
        with pytest.raises(Exception, match="invalid duration"):
            spark.createDataFrame([(bad,)], "s string").select(
                scalars.parse_duration(F.col("s"))
            ).collect()


def test_entity_ids_are_ordered_escaped_and_injective(spark):
    values = ["x", "x|y", "y|z", "z", "\\", "\\|", "|", "a\\"]
    pairs = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    columns = {"b_key": F.col("b"), "a_key": F.col("a")}
    out = pairs.select(
        "a", "b", keys.entity_id(columns).alias("id"), keys.online_key("v", columns).alias("k")
    ).withColumn("parts", keys.entity_id_parts(F.col("id")))
    rows = out.collect()
    assert len({r["id"] for r in rows}) == len(values) ** 2
    assert all(r["parts"] == [r["a"], r["b"]] and r["k"] == "v:" + r["id"] for r in rows)
    swapped = {"user_id": F.lit("u1"), "merchant_id": F.lit("m9")}
    assert one(spark, i=keys.entity_id(swapped))["i"] == "m9|u1"
    assert one(spark, i=keys.entity_id({"a": F.lit(None), "b": F.lit("x")}))["i"] is None


def test_derived_views_are_validated_together(spark):
    df = spark.createDataFrame([(10.0, 4)], "amount double, txn_amount_avg_30d long")
    assert with_derived(df, ["amount_to_avg_ratio"]).first()["amount_to_avg_ratio"] == 2.5
    with pytest.raises(LookupError, match="nothing.*txn_amount_sum_30d"):
        with_derived(df, ["nothing", "transaction_ratios"])
    assert usable(df, ["nothing", "transaction_ratios", "amount_to_avg_ratio"]) == ["amount_to_avg_ratio"]
    own = {"double": DerivedView("amount double", {"twice": lambda: F.col("amount") * 2})}
    assert with_derived(df, ["double"], own).first()["twice"] == 20.0
    with pytest.raises(LookupError, match="is string"):
        with_derived(df.withColumn("amount", F.lit("x")), ["double"], own)


def test_entity_id_parts_keep_empty_values(spark):
    df = spark.createDataFrame([("m1|",), ("|",), ("a\\|b|c",)], "id string")
    got = [r[0] for r in df.select(keys.entity_id_parts(F.col("id"))).collect()]
    assert got == [["m1", ""], ["", ""], ["a|b", "c"]]


def test_durations_too_long_are_an_error(spark):
    df = spark.createDataFrame([("1" * 19 + "d",)], "d string")
    with pytest.raises(Exception, match="invalid duration"):
        df.select(scalars.parse_duration(F.col("d"))).collect()


def test_feature_vector_splits_by_type_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, 2.5, "x", None)], "a long, b double, c string, d string")
    maps = feature_vector(df, ["a", "b", "c", "d"])
    got = df.select(
        *[c.alias(n) for n, c in maps.items()], status_map({"a": F.lit(1)}).alias("status")
    ).first()
    assert got["numeric"] == {"a": 1.0, "b": 2.5}
    assert got["text"] == {"c": "x"} and got["status"] == {"a": 1}


def test_json_messages_are_decoded(spark):
    text = '{"transaction_id":"t","user_id":"u","amount":1.5,"event_ts":"2026-05-01T00:00:00Z"}'
    df = spark.createDataFrame([(text.encode(),), (b"broken",)], "value binary")
    rows = decode_transactions(df).collect()
    assert (rows[0]["transaction_id"], rows[0]["amount"]) == ("t", 1.5)
    assert rows[0]["merchant_id"] is None and rows[1]["transaction_id"] is None


def test_kafka_offsets_are_checked(spark):
    with pytest.raises(ValueError):
        kafka_transactions(spark, "localhost:1", starting_offsets="middle")
    with pytest.raises(ValueError):
        kafka_options("localhost:1", starting_offsets={"t": {0: -3}})


def test_kafka_options_name_group_and_offsets():
    options = kafka_options("h:1", "t", group="readers", starting_offsets={"t": {0: 12, 1: -2}}, max_offsets=5)
    assert options["kafka.group.id"] == "readers" and options["maxOffsetsPerTrigger"] == "5"
    assert options["startingOffsets"] == '{"t": {"0": 12, "1": -2}}' and options["subscribe"] == "t"
    assert "kafka.group.id" not in kafka_options("h:1") and kafka_options("h:1")["startingOffsets"] == "latest"
