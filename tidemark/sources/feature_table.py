"""The offline feature table: Parquet, one folder per write and ``event_date``, upserts by (entity, time).

Every change is a new version (see ``commits``): days it touches get new folders, the others keep theirs, and readers hold
on to the version they began with. Past versions can be read back. Writers that collide begin anew on the other's version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import entity_id_parts
from tidemark.functions.scalars import event_date
from tidemark.operators.asof import AsOfView, point_in_time_join_views
from tidemark.sources.commits import KEEP, RUN, CommitLog, now_utc
from tidemark.sources.folders import drop_folder, has_data, subfolders

PARTITION = "event_date"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
RETENTION_DAYS = 1095  # fixed value: three years


def utc(moment: datetime) -> datetime:
    """Aware UTC; a naive datetime is taken as UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(moment: datetime) -> Column:
    """A timestamp literal that does not depend on the driver's zone."""
    return F.timestamp_micros(F.lit((utc(moment) - EPOCH) // timedelta(microseconds=1)))


def prune(start: datetime, end: datetime) -> Column:
    """Partition predicate for the days of [start, end]."""
    return F.col(PARTITION).between(F.lit(utc(start).date()), F.lit(utc(end).date()))


def partition_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """The days from start to end, both included, as ``partition_date``."""
    days = spark.range((end - start).days + 1)
    return days.select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("partition_date"))


def with_partition(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    return df.withColumn(PARTITION, event_date(F.col(ts)))


def spine_range(spine: DataFrame, ts: str = "event_ts") -> DataFrame:
    return spine.agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def time_bounds(spine: DataFrame, ts: str = "event_ts") -> tuple[datetime, datetime] | None:
    """First and last time on the driver as aware UTC; None if there is none."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = spine.agg(F.min(at), F.max(at)).first()
    if low is None:
        return None
    return EPOCH + timedelta(microseconds=low), EPOCH + timedelta(microseconds=high)


def newest_version(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: greatest by ``order``, then by the remaining columns, as a partial max."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def latest_per_entity(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """Newest row per entity by (event_ts, created_ts); rows without an entity are dropped."""
    order = [c for c in ("event_ts", "created_ts") if c in df.columns]
    return newest_version(df.where(F.col(key).isNotNull()), [key], order)


def _day(folder: str) -> date:
    """Day of a partition folder's name."""
    return date.fromisoformat(folder.split("=", 1)[1])


def _by_day(state: dict) -> dict[str, list[str]]:
    """Folders per day of a version."""
    return {d: [f"{run}/{PARTITION}={d}" for run in runs] for d, runs in sorted(state.get("days", {}).items())}


def _folders(state: dict) -> list[str]:
    return [f for found in _by_day(state).values() for f in found]


def _paths(run: str, days: Sequence[date]) -> list[str]:
    return [f"{run}/{PARTITION}={d.isoformat()}" for d in days]


def _run(folder: str) -> str:
    return folder.partition("/")[0]


@dataclass(frozen=True)
class WriteResult:
    rows_written: int
    partitions: tuple[date, ...]


class FeatureTable:
    """Rows ``entity_id, event_ts, <features>, created_ts, event_date`` of one feature view."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        features: str | T.StructType,
        *,
        clock: Callable[[], datetime] = now_utc,
        keep: int = KEEP,
    ):
        """``clock`` gives the time of a version, ``keep`` says how many of them can be read back."""
        if isinstance(features, str):
            features = T.StructType.fromDDL(features)
        self.spark, self.name, self.keep = spark, name, keep
        self.path = f"{root.rstrip('/')}/{name}"
        self.log = CommitLog(spark, self.path, clock)
        self._measured: dict[str, dict] = {}
        self.features = [f.name for f in features]
        self.schema = T.StructType(
            [
                T.StructField("entity_id", T.StringType()),
                T.StructField("event_ts", T.TimestampType()),
                *features.fields,
                T.StructField("created_ts", T.TimestampType()),
                T.StructField(PARTITION, T.DateType()),
            ]
        )

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField(RUN, T.StringType())])
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(stored).option("basePath", self.path).parquet(*paths).drop(RUN)

    def _scan(
        self, start: date | None = None, end: date | None = None, *, days: Sequence[date] | None = None, state: dict | None = None
    ) -> DataFrame:
        """The newest version's rows (or a given state's), of the days from ``start`` to ``end`` or of those listed."""
        state = self.log.newest()[1] if state is None else state
        wanted = None if days is None else {d.isoformat() for d in days}
        first, last = ("" if start is None else start.isoformat()), ("9999" if end is None else end.isoformat())
        return self._read(
            [f for day, found in _by_day(state).items() if first <= day <= last and (wanted is None or day in wanted) for f in found]
        )

    def _everything(self) -> DataFrame:
        """All days of the newest version, between bounds that the scan is given as a predicate."""
        days = self.days()
        rows = self._scan(days=days)
        return rows.where(F.col(PARTITION).between(F.lit(days[0]), F.lit(days[-1]))) if days else rows

    def conform(self, df: DataFrame) -> DataFrame:
        """Columns and types of the declared schema; ``event_date`` derived from ``event_ts``."""
        df = with_partition(df)
        return df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schema
            ]
        )

    def days(self) -> list[date]:
        """The days stored, from the newest version alone."""
        return sorted(map(date.fromisoformat, _by_day(self.log.newest()[1])))

    # -- reads -------------------------------------------------------------------------------

    def read_range(
        self, start: datetime, end: datetime, *, closed: bool = False, state: dict | None = None
    ) -> DataFrame:
        """Rows in [start, end), or [start, end] if ``closed``; reads only those days' folders."""
        ts = F.col("event_ts")
        upper = ts <= instant(end) if closed else ts < instant(end)
        rows = self._scan(utc(start).date(), utc(end).date(), state=state)
        return rows.where(prune(start, end) & (ts >= instant(start)) & upper)

    def snapshot(self, as_of: datetime, start: datetime, end: datetime) -> DataFrame:
        """[start, end) of the table as it was at a past moment: the newest version made by then.

        The last ``keep`` versions can be read back; days that were erased or expired since are gone from all of them.
        """
        state = self.log.as_of(utc(as_of))
        days = {d: [f for f in found if has_data(self.spark, f"{self.path}/{f}")] for d, found in _by_day(state).items()}
        return self.read_range(start, end, state={"days": {d: [_run(f) for f in found] for d, found in days.items()}})

    def known_at(self, as_of: datetime, start: datetime, end: datetime) -> DataFrame:
        """[start, end) as it stood at a past instant: versions written later are ignored.

        ``upsert`` keeps one version per key, so this needs rows added with ``append_versions``.
        """
        seen = self.read_range(start, end).where(F.col("created_ts") <= instant(as_of))
        return newest_version(seen, ["entity_id", "event_ts"], ["created_ts"])

    def latest_event_ts(self) -> DataFrame:
        """One row with the greatest ``event_ts`` (null if empty), read from the newest day only."""
        days = self.days()
        rows = self._scan(days=days[-1:])
        if days:
            rows = rows.where(F.col(PARTITION) == F.lit(days[-1]))
        return rows.agg(F.max("event_ts").alias("latest_event_ts"))

    def day_stats(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """``(event_date, rows, latest_event_ts, nulls)`` per stored day, as the writes noted them: no file is opened.

        Versions kept beside each other (``append_versions``) count as often as they are stored.
        """
        state = self.log.newest()[1]
        first, last = ("" if start is None else start.isoformat()), ("9999" if end is None else end.isoformat())
        found = []
        for day, runs in state.get("days", {}).items():
            stats = [state["stats"][f"{run}/{day}"] for run in runs]
            if first <= day <= last:
                nulls = {f: sum(s["nulls"].get(f, 0) for s in stats) for f in self.features}
                latest = max((s["latest"] for s in stats if s["latest"] is not None), default=None)
                found.append((date.fromisoformat(day), sum(s["rows"] for s in stats), latest, nulls))
        schema = f"{PARTITION} date, rows long, latest long, nulls map<string,long>"
        stats = self.spark.createDataFrame(found, schema)
        return stats.withColumn("latest", F.timestamp_micros("latest")).withColumnRenamed("latest", "latest_event_ts")

    def rows_per_entity(self, start: date | None = None, end: date | None = None) -> int:
        """A bound on the rows of any entity over the days from start to end: the most of each write and day, added up."""
        state = self.log.newest()[1]
        first, last = ("" if start is None else start.isoformat()), ("9999" if end is None else end.isoformat())
        found = [
            state["stats"][f"{run}/{day}"]["most"]
            for day, runs in state.get("days", {}).items()
            if first <= day <= last
            for run in runs
        ]
        return sum(found)

    def partition_counts(self) -> DataFrame:
        """Rows per stored day, as the writes noted them."""
        return self.day_stats().select(PARTITION, "rows").orderBy(PARTITION)

    def view_for(
        self,
        start: datetime,
        end: datetime,
        ttl: timedelta | None = None,
        columns: Sequence[str] | None = None,
        known_at: datetime | None = None,
    ) -> AsOfView:
        """As-of input for spine rows within [start, end]: no older than the first row minus ttl.

        With ``known_at`` each row is the newest version written by then.
        """
        if ttl is None:
            rows = self._everything().where(
                (F.col(PARTITION) <= F.lit(utc(end).date())) & (F.col("event_ts") <= instant(end))
            )
        else:
            rows = self.read_range(utc(start) - ttl, end, closed=True)
        if known_at is not None:
            rows = rows.where(F.col("created_ts") <= instant(known_at))
            rows = newest_version(rows, ["entity_id", "event_ts"], ["created_ts"])
        columns = tuple(columns or self.features)
        rows = rows.select("entity_id", "event_ts", "created_ts", *columns)
        bound = self.rows_per_entity(None if ttl is None else (utc(start) - ttl).date(), utc(end).date())
        return AsOfView(self.name, rows, ttl=ttl, columns=columns, rows_per_key=bound)

    def as_of(
        self,
        spine: DataFrame,
        *,
        ttl: timedelta | None = None,
        event_ts: str = "event_ts",
        columns: Sequence[str] | None = None,
        spine_keys_only: bool = False,
    ) -> DataFrame:
        """As-of join against the stored table, scanning only days and columns that can match.

        With ``spine_keys_only`` feature rows of entities that the spine lacks are left out before anything is shuffled
        (by a broadcast of the spine's distinct keys where adaptive execution finds them small, else by a Bloom filter
        where Spark's runtime filters apply): for a spine of few entities against a large table.
        """
        # A spine without any time matches nothing, so a range before all data will do.
        start, end = time_bounds(spine, event_ts) or (EPOCH, EPOCH)
        view = self.view_for(start, end, ttl, columns)
        if spine_keys_only:
            wanted = spine.select("entity_id").distinct()
            view = replace(view, frame=view.frame.join(wanted, "entity_id", "left_semi"))
        return point_in_time_join_views(spine, [view], event_ts=event_ts)

    # -- writes ------------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> tuple[str, list[date]]:
        """Write rows to a folder of their own, by day; its name and the days it has."""
        run = self.log.new_run()
        # Rebalance lets adaptive execution split a crowded day and merge thin ones.
        (
            df.hint("rebalance", PARTITION)
            .sortWithinPartitions(PARTITION, "entity_id", "event_ts")
            .write.partitionBy(PARTITION)
            .parquet(f"{self.path}/{run}")
        )
        folders = subfolders(self.spark, f"{self.path}/{run}")
        if f"{PARTITION}=__HIVE_DEFAULT_PARTITION__" in folders:
            drop_folder(self.spark, f"{self.path}/{run}")
            raise ValueError("event_ts must not be null")
        days = [_day(f) for f in folders]
        self._measured |= self._measure(run, days)
        return run, days

    def _measure(self, run: str, days: Sequence[date]) -> dict[str, dict]:
        """Per day of a write its rows, the most of one entity, newest event time and missing values.

        One pass over what was written.
        """
        if not days:
            return {}
        kinds = {f.name: f.dataType for f in self.schema}

        def missing(name: str) -> Column:
            column = F.col(name)
            if isinstance(kinds[name], T.FloatType | T.DoubleType):
                return column.isNull() | F.isnan(column)
            return column.isNull()

        nulls = [f"_n{i}" for i in range(len(self.features))]
        by_entity = self._read(_paths(run, days)).groupBy(PARTITION, "entity_id").agg(
            F.count(F.lit(1)).alias("rows"),
            F.max(F.unix_micros("event_ts")).alias("latest"),
            *[F.count_if(missing(f)).alias(n) for f, n in zip(self.features, nulls)],
        )
        found = by_entity.groupBy(PARTITION).agg(
            F.max("rows").alias("most"),
            F.sum("rows").alias("rows"),
            F.max("latest").alias("latest"),
            F.array(*[F.sum(n) for n in nulls]).alias("nulls"),
        )
        return {
            f"{run}/{r[PARTITION].isoformat()}": {
                "rows": r["rows"],
                "most": r["most"],
                "latest": r["latest"],
                "nulls": dict(zip(self.features, r["nulls"])),
            }
            for r in found.collect()
        }

    def _commit(self, step: Callable[[dict[str, list[str]]], dict[str, list[str]] | None]) -> None:
        """Make a version of what ``step`` turns the runs per day into; None leaves the table as it is."""

        def whole(state: dict) -> dict | None:
            days = step({d: list(runs) for d, runs in state.get("days", {}).items()})
            if days is None:
                return None
            days = {d: runs for d, runs in days.items() if runs}
            known = state.get("stats", {}) | self._measured
            stats = {k: known[k] for d, runs in days.items() for run in runs if (k := f"{run}/{d}") in known}
            return {"days": days, "stats": stats}

        self.log.change(whole)
        self._measured = {}
        self.log.tidy(_folders, self.keep)

    def upsert(self, incoming: DataFrame) -> WriteResult:
        """Merge by (entity_id, event_ts): greatest ``created_ts`` wins, equal goes to the incoming row.

        The incoming rows are written once, in the table's layout. Days the table does not have yet take those folders as
        they are; the other days are merged into new ones. All days change in one version, and a run that fails part way
        has changed nothing.
        """
        keys = ["entity_id", "event_ts", PARTITION]
        run, days = self._write(newest_version(self.conform(incoming), keys, ["created_ts"]))
        if not days:
            return WriteResult(0, ())
        rows_written = sum(self._measured[f"{run}/{d.isoformat()}"]["rows"] for d in days)

        def merged(stored: dict[str, list[str]]) -> dict[str, list[str]]:
            overlap = [d for d in days if d.isoformat() in stored]
            fresh = {d.isoformat(): [run] for d in days}
            if overlap:
                old = self._scan(days=overlap, state={"days": stored}).withColumn("_incoming", F.lit(0))
                new = self._read(_paths(run, overlap)).withColumn("_incoming", F.lit(1))
                both = newest_version(old.unionByName(new), keys, ["created_ts", "_incoming"])
                joint, _ = self._write(both.select(*self.schema.names))
                fresh |= {d.isoformat(): [joint] for d in overlap}
            return stored | fresh

        self._commit(merged)
        return WriteResult(rows_written, tuple(days))

    def replace_days(self, df: DataFrame, days: Sequence[date]) -> None:
        """Recompute whole days: they end up holding ``df``'s rows and nothing else."""
        run, made = self._write(self.conform(df).where(F.col(PARTITION).isin(*days)))
        self._commit(lambda stored: stored | {d.isoformat(): [run] if d in made else [] for d in days})

    def append_versions(self, incoming: DataFrame) -> None:
        """Add rows beside earlier versions of them, for tables read with ``known_at``."""
        run, days = self._write(self.conform(incoming))
        self._commit(lambda stored: stored | {d.isoformat(): [*stored.get(d.isoformat(), []), run] for d in days})

    def expire(self, today: date, days: int = RETENTION_DAYS) -> list[date]:
        """Drop days older than ``days``, from past versions too; no rows are read or rewritten."""
        cutoff = today - timedelta(days=days)
        dropped = [d for d in self.days() if d < cutoff]
        if dropped:
            self._drop_days({d.isoformat(): [] for d in dropped})
        return dropped

    def _drop_days(self, changed: dict[str, list[str]]) -> None:
        """Give days other runs (or none) and delete all folders that they had in any version."""
        self._commit(lambda stored: stored | changed)
        names = {f"{PARTITION}={d}" for d in changed}
        self.log.purge(_folders, lambda folder: folder.partition("/")[2] in names)

    def erasure_counts(self, targets: DataFrame) -> DataFrame:
        """Rows per requested key that ``erase`` would remove."""
        found = targets if PARTITION in targets.columns else self._located(targets)
        return found.groupBy(F.col("requested").alias("entity_id")).agg(F.sum("rows").alias("rows_deleted"))

    def erase(self, targets: DataFrame) -> list[date]:
        """Delete the rows of all target entities, from past versions too; rewrites only the days that hold any.

        Targets that ``targets`` found in the version that is still the newest tell the days; others are looked for.
        """
        version, state = self.log.newest()
        current = PARTITION in targets.columns and targets.where(F.col("version") != version).isEmpty()
        found = targets if current else self._located(targets.select("entity_id"))
        once = found.select("entity_id", PARTITION, "rows").distinct()
        gone = {r[PARTITION]: r["rows"] for r in once.groupBy(PARTITION).agg(F.sum("rows").alias("rows")).collect()}
        stored = {
            d: sum(state["stats"][f"{run}/{d.isoformat()}"]["rows"] for run in state["days"][d.isoformat()]) for d in gone
        }
        changed = {d.isoformat(): [] for d in gone}
        thinned = sorted(d for d in gone if gone[d] < stored[d])
        if thinned:
            left = self._scan(days=thinned).join(targets.select("entity_id").distinct(), "entity_id", "left_anti")
            run, _ = self._write(left.select(*self.schema.names))
            changed |= {d.isoformat(): [run] for d in thinned}
        if changed:
            self._drop_days(changed)
        return sorted(gone)

    def targets(self, requests: DataFrame, key: str = "entity_id") -> DataFrame:
        """``entity_id, requested, event_date, rows, version``: what of the newest version is to go, from one read of it."""
        return self._found(requests.select(F.col(key).cast("string").alias("requested")).distinct(), parts=True)

    def _located(self, targets: DataFrame) -> DataFrame:
        """The same for entities that are named in full."""
        named = "requested" if "requested" in targets.columns else "entity_id"
        located = self._found(targets.select(F.col("entity_id").alias("requested")).distinct(), parts=False)
        asked = targets.select("entity_id", F.col(named).alias("requested")).distinct()
        return located.drop("requested").join(asked, "entity_id")

    def _found(self, wanted: DataFrame, *, parts: bool) -> DataFrame:
        version, _ = self.log.newest()
        names = F.array("entity_id")
        if parts:
            names = F.array_distinct(F.concat(names, entity_id_parts(F.col("entity_id"))))
        ids = self._everything().where(F.col("entity_id").isNotNull()).select("entity_id", PARTITION, F.explode(names).alias("requested"))
        # Rows that nobody asked for go no further than their scan.
        found = ids.join(wanted, "requested", "left_semi").groupBy("entity_id", "requested", PARTITION)
        return found.agg(F.count(F.lit(1)).alias("rows")).withColumn("version", F.lit(version))


def matching_entities(table: DataFrame, requests: DataFrame, key: str = "entity_id") -> DataFrame:
    """``entity_id, requested``: stored entities whose id, or a part of it, is requested."""
    wanted = requests.select(F.col(key).cast("string").alias("requested")).distinct()
    entities = table.select("entity_id").where(F.col("entity_id").isNotNull()).distinct()
    names = F.array_distinct(F.concat(F.array("entity_id"), entity_id_parts(F.col("entity_id"))))
    return (
        entities.select("entity_id", F.explode(names).alias("requested"))
        .join(wanted, "requested", "left_semi")
        .select("entity_id", "requested")
    )

