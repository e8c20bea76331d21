"""The latest-value table: one row per entity with an expiry, as a base and a log of changes.

Rows are ``entity_id, <features>, event_ts, written_ts, expires_at``. A write, an extension of lifetimes or a stream's
micro-batch is appended as a delta that holds its own entities only, and takes effect as a new version (see ``commits``).
Readers merge the deltas into the base in the order of their versions. ``COMPACT_AFTER`` deltas are merged into a new base.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import entity_id
from tidemark.functions.packing import MISSING, PRESENT, STALE, feature_vector, status_map
from tidemark.functions.scalars import parse_duration_text
from tidemark.sources.commits import RUN, CommitLog, now_utc
from tidemark.sources.feature_table import instant, matching_entities, newest_version

#: Deltas that a reader has to merge at most; the write that reaches the number makes a new base.
COMPACT_AFTER = 16
#: Versions that readers may still be on.
KEEP = 4
#: Names of writes that are remembered, so that a repeated one changes nothing.
TOKENS = 100
# What a delta's row does: replaces the entity's row, replaces one that is not newer, or gives a live row a new expiry.
_PUT, _PUT_NEWEST, _EXTEND = 0, 1, 2
# Lifetime per serving tier.
TIER_TTL = {"hot": "24h", "cold": "7d"}


def tier_ttl(tier: str) -> timedelta:
    return parse_duration_text(TIER_TTL[tier])


def _folders(state: dict) -> list[str]:
    return [*([state["base"]] if state.get("base") else []), *state.get("deltas", [])]


class LatestTable:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        features: str | T.StructType,
        buckets: int | None = None,
        *,
        compact_after: int = COMPACT_AFTER,
        clock: Callable[[], datetime] = now_utc,
    ):
        """``buckets`` is the number of files of a base, 32 unless given, fixed when the table is first written."""
        if isinstance(features, str):
            features = T.StructType.fromDDL(features)
        self.spark, self.name, self.compact_after = spark, name, compact_after
        self.path = f"{root.rstrip('/')}/{name}"
        self.log = CommitLog(spark, self.path, clock)
        self.buckets = self.log.newest()[1].get("buckets") or buckets or 32
        if buckets not in (None, self.buckets):
            raise ValueError(f"{name} was made with {self.buckets} buckets, not {buckets}")
        self.features = [f.name for f in features]
        self.schema = T.StructType(
            [
                T.StructField("entity_id", T.StringType()),
                *features.fields,
                T.StructField("event_ts", T.TimestampType()),
                T.StructField("written_ts", T.TimestampType()),
                T.StructField("expires_at", T.TimestampType()),
            ]
        )

    # -- reads -------------------------------------------------------------------------------

    def _read(self, runs: Sequence[str], *extra: T.StructField) -> DataFrame:
        stored = T.StructType([*self.schema.fields, *extra, T.StructField(RUN, T.StringType())])
        if not runs:
            return self.spark.createDataFrame([], stored)
        paths = [f"{self.path}/{run}" for run in runs]
        return self.spark.read.schema(stored).option("basePath", self.path).parquet(*paths)

    def rows(self, keys: DataFrame | None = None, *, state: dict | None = None) -> DataFrame:
        """The newest version's rows; given ``keys(entity_id)``, only theirs, picked before anything is merged."""
        state = self.log.newest()[1] if state is None else state
        runs = state.get("deltas", [])
        base = self._read([state["base"]] if state.get("base") else []).drop(RUN)
        deltas = self._read(runs, T.StructField("_op", T.IntegerType()))
        if keys is not None:
            wanted = keys.select("entity_id").distinct()
            base, deltas = (x.join(wanted, "entity_id", "left_semi") for x in (base, deltas))
        if not runs:
            return base
        names = [n for n in self.schema.names if n != "entity_id"]
        order = F.create_map(*[F.lit(x) for i, run in enumerate(runs) for x in (run.partition("=")[2], i)])
        # A delta has an entity once, so no list is longer than the number of deltas.
        steps = deltas.groupBy(F.col("entity_id").alias("_id")).agg(
            F.array_sort(
                F.collect_list(F.struct(order[F.col(RUN)].alias("n"), "_op", F.struct(*names).alias("row"))),
                lambda a, b: a["n"] - b["n"],
            ).alias("_steps")
        )
        stored = base.select("entity_id", F.struct(*names).alias("_row"))
        both = stored.join(steps, F.col("entity_id").eqNullSafe(F.col("_id")), "full_outer")

        def step(row: Column, change: Column) -> Column:
            given, op = change["row"], change["_op"]
            newer = row.isNull() | row["event_ts"].isNull() | (given["event_ts"] >= row["event_ts"])
            replaced = F.when((op == _PUT) | (op == _PUT_NEWEST) & newer, given)
            alive = row.isNotNull() & (row["expires_at"] > given["written_ts"])
            longer = F.struct(*[(given if n == "expires_at" else row)[n].alias(n) for n in names])
            return replaced.when((op == _EXTEND) & alive, longer).otherwise(row)

        unchanged = F.coalesce("_steps", F.array().cast(both.schema["_steps"].dataType))
        merged = both.select(F.coalesce("entity_id", "_id").alias("entity_id"), F.aggregate(unchanged, F.col("_row"), step).alias("_row"))
        return merged.where("_row IS NOT NULL").select("entity_id", "_row.*")

    def read(self, requests: DataFrame, now: datetime) -> DataFrame:
        """Every request row with its entity's features; an absent or expired entity gives nulls."""
        live = self.rows(requests).where(F.col("expires_at") > instant(now))
        live = live.select("entity_id", *self.features)
        return requests.join(live, "entity_id", "left")

    # -- writes ------------------------------------------------------------------------------

    def _append(self, rows: DataFrame, token: str | None = None) -> int:
        """Write a delta and make it a version; how many rows it has. A known ``token`` changes nothing."""
        run = self.log.new_run()
        rows.select(*self.schema.names, "_op").write.parquet(f"{self.path}/{run}")
        count = self._read([run]).count()

        def step(state: dict) -> dict | None:
            if not count or token is not None and token in state.get("tokens", []):
                return None
            tokens = [*state.get("tokens", []), token][-TOKENS:] if token is not None else state.get("tokens", [])
            deltas = [*state.get("deltas", []), run]
            return state | {"buckets": self.buckets, "deltas": deltas, "tokens": tokens}

        made = self.log.change(step)
        if made is not None and len(made["deltas"]) >= self.compact_after:
            self.compact()
        return count

    def _rebase(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Make a base of the merged rows, as ``change`` leaves them, and begin the log of changes anew."""

        def step(state: dict) -> dict:
            run = self.log.new_run()
            rows = change(self.rows(state=state)).repartition(self.buckets, "entity_id")
            rows.sortWithinPartitions("entity_id").write.parquet(f"{self.path}/{run}")
            return state | {"buckets": self.buckets, "base": run, "deltas": []}

        self.log.change(step)

    def compact(self) -> None:
        """Merge the deltas into a new base; bases and deltas that no kept version has are deleted."""
        self._rebase(lambda rows: rows)
        self.log.tidy(_folders, KEEP)

    def write(
        self,
        latest: DataFrame,
        now: datetime | Column,
        ttl: timedelta,
        *,
        newest_wins: bool = False,
        token: str | None = None,
    ) -> None:
        """Upsert one row per entity. The incoming row wins; with ``newest_wins`` only if not older.

        ``now`` is the write time, or a column of ``latest`` that holds it per row. A write with a ``token`` that the table
        remembers has happened already and changes nothing.
        """
        if token is not None and token in self.log.newest()[1].get("tokens", []):
            return
        moment = now if isinstance(now, Column) else instant(now)
        incoming = latest.select(
            F.col("entity_id").cast("string"),
            *[F.col(f.name).cast(f.dataType) for f in self.schema if f.name in self.features],
            F.col("event_ts").cast("timestamp"),
            moment.alias("written_ts"),
            (moment + F.lit(ttl)).alias("expires_at"),
        )
        newest = newest_version(incoming, ["entity_id"], ["event_ts"])
        self._append(newest.withColumn("_op", F.lit(_PUT_NEWEST if newest_wins else _PUT)), token)

    def extend_ttl(self, keys: DataFrame, now: datetime, ttl: timedelta) -> DataFrame:
        """Give the listed live entities a new expiry; returns how many that were."""
        moment = instant(now)
        live = self.rows(keys).where(F.col("expires_at") > moment)
        changed = live.withColumns({"written_ts": moment, "expires_at": moment + F.lit(ttl), "_op": F.lit(_EXTEND)})
        count = self._append(changed)
        return self.spark.createDataFrame([(self.name, count)], "feature_view string, extended long")

    def targets(self, requests: DataFrame, key: str = "entity_id") -> DataFrame:
        return matching_entities(self.rows(), requests, key)

    def erasure_counts(self, targets: DataFrame) -> DataFrame:
        return (
            self.rows(targets)
            .join(targets, "entity_id")
            .groupBy(F.col("requested").alias("entity_id"))
            .agg(F.count(F.lit(1)).alias("rows_deleted"))
        )

    def erase(self, targets: DataFrame) -> None:
        """Delete the target entities, from past versions too."""
        gone = targets.select("entity_id").distinct()
        if self.rows(gone).isEmpty():
            return
        self._rebase(lambda rows: rows.join(gone, "entity_id", "left_anti"))
        self.log.purge(_folders, lambda folder: True)


def lookup(
    requests: DataFrame,
    tables: Sequence[tuple[LatestTable, Sequence[str]]],
    now: datetime,
    *,
    services: Mapping[str, Sequence[str]] | None = None,
    service: str | None = None,
) -> DataFrame:
    """Features and statuses of every request row over several views.

    ``tables`` pairs each latest table with the request columns that form its entity. Each view adds
    ``<view>__status`` (1 present, 2 missing, 3 stale). A feature two views share takes the later
    view's value where that view is present. A ``service`` name narrows to its views (unknown: none).
    """
    if service is not None:
        wanted = (services or {}).get(service, ())
        tables = [(t, keys) for t, keys in tables if t.name in wanted]
    out, features = requests, []
    for table, keys in tables:
        packed = F.struct("expires_at", *table.features).alias("_found")
        stored = table.rows().select(F.col("entity_id").alias("_id"), packed)
        encoded = F.col(keys[0]) if len(keys) == 1 else entity_id({k: F.col(k) for k in keys})
        out = out.withColumn("_want", encoded.cast("string"))
        out = out.join(stored, F.col("_want") == F.col("_id"), "left")
        found = F.col("_found")
        live = found.isNotNull() & (found["expires_at"] > instant(now))
        status = (
            F.when(found.isNull(), MISSING).when(live, PRESENT).otherwise(STALE).cast("int")
        )
        added = {f"{table.name}__status": status}
        for name in table.features:
            earlier = F.col(name) if name in features else F.lit(None)
            added[name] = F.when(live, found[name]).otherwise(earlier)
            if name not in features:
                features.append(name)
        out = out.withColumns(added).drop("_want", "_id", "_found")
    return out


def lookup_vectors(requests: DataFrame, tables: Sequence[tuple[LatestTable, Sequence[str]]], now: datetime, **options) -> DataFrame:
    """``lookup`` with its answer packed: ``numeric`` and ``text`` hold the features that are there, ``statuses`` has every
    view's status by name. ``options`` are those of ``lookup``."""
    found = lookup(requests, tables, now, **options)
    views = [c.removesuffix("__status") for c in found.columns if c.endswith("__status") and c not in requests.columns]
    features = [c for c in found.columns if c not in requests.columns and not c.endswith("__status")]
    packed = feature_vector(found, features) | {"statuses": status_map({v: F.col(f"{v}__status") for v in views})}
    return found.select(*requests.columns, *[c.alias(n) for n, c in packed.items()])


def prewarm(
    tables: Sequence[LatestTable],
    peaks: DataFrame,
    hot: DataFrame,
    now: datetime,
    *,
    ttl: timedelta = timedelta(hours=6),
    lead: timedelta = timedelta(minutes=30),
) -> DataFrame:
    """Extend the hottest entities of every view whose peak starts within ``lead``.

    ``peaks`` is ``feature_view, start_ts``; ``hot`` is ``feature_view, entity_id``. Returns one row
    per view warmed; expired or absent entities are not brought back.
    """
    start = F.col("start_ts")
    imminent = peaks.where((start >= instant(now)) & (start <= instant(now + lead)))
    names = imminent.select("feature_view").distinct()
    due = {r[0] for r in names.where(F.col("feature_view").isin(*[t.name for t in tables])).collect()}
    warmed = peaks.sparkSession.createDataFrame([], "feature_view string, extended long")
    for table in tables:
        if table.name in due:
            keys = hot.where(F.col("feature_view") == table.name)
            warmed = warmed.unionByName(table.extend_ttl(keys, now, ttl))
    return warmed


def expiry_by_tier(written: Column, tier: Column) -> Column:
    """Write time plus the lifetime of the row's tier."""
    expiry = F.lit(None).cast("timestamp")
    for name in TIER_TTL:
        expiry = F.when(tier == name, written + F.lit(tier_ttl(name))).otherwise(expiry)
    return expiry
