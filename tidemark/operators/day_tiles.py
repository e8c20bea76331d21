"""Day tiles: transactions of an entity with a counterpart, summed up per day, and when each entity was first seen.

Features over 30 and 90 days are put together from tiles instead of from all history: whole days come from the tiles, the
days that a window cuts (its two ends) from the transactions themselves, and the first time from a table of its own, to
which an update adds only entities that are new or were seen earlier than known. So a day costs the same in the tenth year
as in the first, and the result equals a pass over everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import chargeback_rate
from tidemark.operators.batch_features import MONTH, QUARTER, stamp, trailing
from tidemark.operators.sums import double_parts
from tidemark.sources.feature_table import FeatureTable, instant, utc
from tidemark.sources.latest_table import LatestTable

_TILE = "counterpart string, n long, valued long, whole double, fraction double, flagged long"
_MEASURES = ("n", "valued", "whole", "fraction", "flagged")
#: First times don't expire.
_FOREVER = timedelta(days=36_500)


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time(), timezone.utc)


def _of_day(day: date) -> Column:
    at = F.col("event_ts")
    return (at >= instant(_midnight(day))) & (at < instant(_midnight(day + timedelta(days=1))))


class DayTiles:
    """Tiles of transactions by ``entity`` and ``counterpart`` columns, with a count of those that ``flag`` marks."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        *,
        entity: str = "user_id",
        counterpart: str = "merchant_id",
        flag: str = "is_chargeback",
    ):
        self.entity, self.counterpart, self.flag = entity, counterpart, flag
        self.tiles = FeatureTable(spark, root, f"{name}_tiles", _TILE)
        self.first = LatestTable(spark, root, f"{name}_first", "first_ts timestamp")

    def _summed(self, txns: DataFrame, *groups: Column) -> DataFrame:
        """Tile rows of transactions, per entity, counterpart and the given groups."""
        whole, fraction = double_parts(F.col("amount"))
        return txns.groupBy(F.col(self.entity).alias("entity_id"), F.col(self.counterpart).alias("counterpart"), *groups).agg(
            F.count(F.lit(1)).alias("n"),
            F.count("amount").alias("valued"),
            F.sum(whole).alias("whole"),
            F.sum(fraction).alias("fraction"),
            F.count_if(F.col(self.flag)).alias("flagged"),
        )

    def update(self, txns: DataFrame, days: Sequence[date], now: datetime) -> None:
        """Make the tiles of whole days anew; ``txns`` has all transactions of those days."""
        some = txns.where(F.col(self.entity).isNotNull() & reduce(Column.__or__, map(_of_day, days)))
        tiles = self._summed(some, F.date_trunc("day", "event_ts").alias("event_ts"))
        self.tiles.replace_days(tiles.withColumn("created_ts", instant(now)), days)

    def see(self, txns: DataFrame, now: datetime) -> None:
        """Note when the entities of ``txns`` were first seen. Times only get earlier: what is taken back stays known."""
        seen = txns.where(F.col(self.entity).isNotNull() & F.col("event_ts").isNotNull())
        seen = seen.groupBy(F.col(self.entity).cast("string").alias("entity_id")).agg(F.min("event_ts").alias("first_ts"))
        known = self.first.rows(seen).select("entity_id", F.col("first_ts").alias("_known"))
        earlier = seen.join(known, "entity_id", "left").where("_known IS NULL OR first_ts < _known").drop("_known")
        self.first.write(earlier.withColumn("event_ts", F.col("first_ts")), now, _FOREVER)

    def parts(self, txns: DataFrame, as_of: datetime, widths: Sequence[timedelta]) -> DataFrame:
        """Tile rows that make up the windows ``[as_of - width, as_of]``, with a column ``in_<i>`` for the i-th of them."""
        as_of = utc(as_of)
        starts = [as_of - width for width in widths]
        cut = sorted({as_of.date(), *[s.date() for s in starts]})
        first = min(starts).date() + timedelta(days=1)
        stored = self.tiles.read_range(_midnight(first), _midnight(as_of.date()))
        whole = stored.where(~F.to_date("event_ts").isin(*cut)).select(
            "entity_id", "counterpart", *_MEASURES, *[(F.col("event_ts") >= instant(s)).alias(f"in_{i}") for i, s in enumerate(starts)]
        )
        inside = [trailing(as_of, width).alias(f"in_{i}") for i, width in enumerate(widths)]
        ends = txns.where(reduce(Column.__or__, map(_of_day, cut)) & trailing(as_of, max(widths)))
        return whole.unionByName(self._summed(ends.where(F.col(self.entity).isNotNull()), *inside))


def user_features_from_tiles(
    tiles: DayTiles,
    txns: DataFrame,
    as_of: datetime,
    *,
    countries: DataFrame | None = None,
    created: datetime | None = None,
) -> DataFrame:
    """``user_features`` from tiles: the same rows, reading 90 days of tiles and three of transactions.

    The tiles must have been updated for every whole day of the window, and ``see`` must know all transactions.
    """
    parts = tiles.parts(txns, as_of, (MONTH, QUARTER))
    month, quarter = F.col("in_0"), F.col("in_1")

    def total(name: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(name))), F.lit(0))

    recent = parts.groupBy("entity_id").agg(
        total("n", month).alias("txn_count_30d"),
        total("valued", month).alias("_valued"),
        (total("whole", month) + total("fraction", month)).cast("double").alias("txn_amount_sum_30d"),
        F.count_distinct(F.when(month, F.col("counterpart"))).alias("distinct_merchants_30d"),
        total("flagged", quarter).alias("_flagged"),
        total("n", quarter).alias("_quarter"),
    )
    known = tiles.first.rows().where(F.col("first_ts") <= instant(as_of)).select("entity_id", "first_ts")
    both = known.join(recent, "entity_id", "left").na.fill(0)
    out = both.select(
        "entity_id",
        F.datediff(instant(as_of), "first_ts").cast("long").alias("account_age_days"),
        "txn_count_30d",
        "txn_amount_sum_30d",
        "distinct_merchants_30d",
        chargeback_rate(F.col("_flagged"), F.col("_quarter")).alias("chargeback_rate_90d"),
        F.when(F.col("_valued") > 0, F.col("txn_amount_sum_30d") / F.col("_valued")).alias("txn_amount_avg_30d"),
    )
    if countries is not None:
        named = countries.select(F.col("user_id").alias("entity_id"), "home_country")
        out = out.join(named, "entity_id", "left")
    return stamp(out, as_of, created)
