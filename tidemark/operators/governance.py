"""Access decisions and audit in bulk, and erasure across all tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.feature_table import FeatureTable, instant
from tidemark.sources.folders import drop_folder, has_data
from tidemark.sources.latest_table import LatestTable

# Who may read which sensitivity, which reads are audited, how a denial reads.
READ_ROLES = {
    "public": ("viewer", "analyst", "ml-engineer", "admin"),
    "financial": ("analyst", "ml-engineer", "admin"),
    "pii": ("ml-engineer", "admin"),
}
AUDITED = ("financial", "pii")
AUDIT_DAY, AUDIT_BATCH = "audit_date", "batch"
DENIAL = "role '%s' cannot read %s features"


def sensitive_views(views: DataFrame) -> DataFrame:
    return views.where(F.col("sensitivity").isin(*AUDITED))


def access_decisions(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Decide every request (``role, sensitivity`` and more): ``allowed, reason, must_audit``."""
    pairs = [(role, level) for level, roles in READ_ROLES.items() for role in roles]
    policy = spark.createDataFrame(pairs, "role string, sensitivity string")
    decided = requests.join(
        F.broadcast(policy.withColumn("_granted", F.lit(True))), ["role", "sensitivity"], "left"
    )
    allowed = F.col("_granted").isNotNull()
    denial = F.format_string(DENIAL, "role", "sensitivity")
    return decided.select(
        *requests.columns,
        allowed.alias("allowed"),
        F.when(allowed, "ok").otherwise(denial).alias("reason"),
        F.coalesce(F.col("sensitivity").isin(*AUDITED), F.lit(False)).alias("must_audit"),
    )


def access_audit(decisions: DataFrame) -> DataFrame:
    """The rows the audit log gets: allowed reads of audited sensitivities."""
    return decisions.where(F.col("allowed") & F.col("must_audit")).drop(
        "allowed", "reason", "must_audit"
    )


class AuditLog:
    """Audited reads, appended by batch into a day-partitioned table.

    A batch has folders of its own under each day, which it replaces when it is appended again: once or twice, the log has
    one copy. Days are those of the reads.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, *, at: str = "read_ts"):
        self.spark, self.path, self.at = spark, path.rstrip("/"), at
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = fields.names
        self.schema = T.StructType(
            [*fields.fields, T.StructField(AUDIT_DAY, T.DateType()), T.StructField(AUDIT_BATCH, T.StringType())]
        )

    def append(self, decisions: DataFrame, batch: str) -> None:
        """Add the audited reads among ``decisions`` under the batch's name (letters, digits, ``-`` and ``_``)."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch is named by letters, digits, - and _")
        rows = access_audit(decisions).select(*self.columns)
        rows = rows.withColumns({AUDIT_DAY: F.to_date(F.col(self.at)), AUDIT_BATCH: F.lit(batch)})
        (
            rows.hint("rebalance", AUDIT_DAY)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(AUDIT_DAY, AUDIT_BATCH)
            .parquet(self.path)
        )

    def read(self, start: datetime, end: datetime) -> DataFrame:
        """The audited reads of [start, end); reads only those days' folders."""
        if not has_data(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows, at = self.spark.read.schema(self.schema).parquet(self.path), F.col(self.at)
        days = F.col(AUDIT_DAY).between(F.lit(start.date()), F.lit(end.date()))
        return rows.where(days & (at >= instant(start)) & (at < instant(end)))


def erase_entities(
    spark: SparkSession,
    requests: DataFrame,
    *,
    offline: Sequence[FeatureTable],
    online: Sequence[LatestTable],
    audit_folder: str,
    erased_at: datetime,
    request_id: str | None = None,
) -> DataFrame:
    """Delete the requested entities (also as part of composite ids) from every table.

    What will be deleted is recorded before anything is. A rerun with the same ``request_id`` (by
    default a digest of the entities and ``erased_at``) takes up that record, finishes the deletes and
    never counts again. The list of ids to delete goes when all is done; the audit stays. Returns this
    run's audit rows: ``entity_id, store, feature_view, rows_deleted, erased_at``.
    """
    wanted = requests.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
    if request_id is None:
        mix = wanted.agg(F.count("*"), F.sum(F.xxhash64("entity_id").cast("decimal(38,0)"))).first()
        request_id = f"{erased_at.isoformat()}-{mix[0]}-{mix[1]}".replace(":", "")
    run = f"{audit_folder.rstrip('/')}/request={request_id}"
    tables = [("offline", t) for t in offline] + [("online", t) for t in online]
    if not has_data(spark, f"{run}/audit"):
        counts = []
        for store, table in tables:
            found = f"{run}/targets/{store}-{table.name}"
            table.targets(wanted).write.mode("overwrite").parquet(found)
            rows = table.erasure_counts(spark.read.parquet(found))
            counts.append(
                wanted.join(rows, "entity_id", "left").select(
                    "entity_id",
                    F.lit(store).alias("store"),
                    F.lit(table.name).alias("feature_view"),
                    F.coalesce("rows_deleted", F.lit(0)).alias("rows_deleted"),
                    instant(erased_at).alias("erased_at"),
                )
            )
        # The audit is written last: with it the record is whole.
        reduce(DataFrame.unionByName, counts).write.mode("overwrite").parquet(f"{run}/audit")
    if has_data(spark, f"{run}/targets"):
        for store, table in tables:
            table.erase(spark.read.parquet(f"{run}/targets/{store}-{table.name}"))
        drop_folder(spark, f"{run}/targets")
    return spark.read.parquet(f"{run}/audit")
