"""Access, erasure and backfill queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_id
from tidemark.operators.backfill import BackfillLog, pending_days, run_backfill, run_rollup
from tidemark.operators.batch_features import user_activity_by_day
from tidemark.operators.governance import (
    AuditLog,
    access_audit,
    access_decisions,
    erase_entities,
    sensitive_views,
)
from tidemark.queries.common import EVENT_TXNS, at, events, exact, plain
from tidemark.session import work_folder
from tidemark.sources.feature_table import FeatureTable, latest_per_entity, partition_days
from tidemark.sources.latest_table import LatestTable

VIEW_LEVELS = [
    ("user_features_v2", "pii"),
    ("merchant_features_v1", "financial"),
    ("transaction_features_v1", "public"),
]


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a read: its type picks the role, its merchant the view."""
    kind, number = F.col("event_type"), F.col("merchant_id").cast("int")
    role = (
        F.when(kind == "click", "viewer")
        .when(kind == "error", "analyst")
        .when(kind == "purchase", "ml-engineer")
        .when(kind == "signup", "admin")
        .otherwise("visitor")
    )
    view = (
        F.when(number < 40, "user_features_v2")
        .when(number < 80, "merchant_features_v1")
        .otherwise("transaction_features_v1")
    )
    reads = events(spark, folder).select(
        "transaction_id",
        F.col("user_id").alias("principal"),
        role.alias("role"),
        view.alias("feature_view"),
    )
    # One row per declared view, so this side is always tiny.
    levels = spark.createDataFrame(VIEW_LEVELS, "feature_view string, sensitivity string")
    return reads.join(F.broadcast(levels), "feature_view")


def access_decisions_(spark, folder):
    return access_decisions(spark, _requests(spark, folder))


def access_audit_(spark, folder):
    return access_audit(access_decisions(spark, _requests(spark, folder)))


DECIDED = f"""{EVENT_TXNS}, r AS (
  SELECT transaction_id, user_id AS principal, CASE event_type WHEN 'click' THEN 'viewer'
      WHEN 'error' THEN 'analyst' WHEN 'purchase' THEN 'ml-engineer' WHEN 'signup' THEN 'admin'
      ELSE 'visitor' END AS role,
    CASE WHEN CAST(merchant_id AS INT) < 40 THEN 'user_features_v2'
      WHEN CAST(merchant_id AS INT) < 80 THEN 'merchant_features_v1'
      ELSE 'transaction_features_v1' END AS feature_view,
    CASE WHEN CAST(merchant_id AS INT) < 40 THEN 'pii' WHEN CAST(merchant_id AS INT) < 80
      THEN 'financial' ELSE 'public' END AS sensitivity FROM events_t),
d AS (SELECT *, CASE sensitivity WHEN 'pii' THEN role IN ('ml-engineer', 'admin')
    WHEN 'financial' THEN role IN ('analyst', 'ml-engineer', 'admin')
    ELSE role <> 'visitor' END AS allowed, sensitivity <> 'public' AS must_audit FROM r)"""
ACCESS_DECISIONS = f"""WITH {DECIDED}
SELECT *, CASE WHEN allowed THEN 'ok' ELSE 'role ''' || role || ''' cannot read ' || sensitivity
  || ' features' END AS reason FROM d"""
ACCESS_AUDIT = f"""WITH {DECIDED} SELECT * EXCLUDE (allowed, must_audit) FROM d
WHERE allowed AND must_audit"""


def audit_log(spark, folder):
    """Reads decided and logged in three batches, one of them twice; the second week read back."""
    reads = _requests(spark, folder).join(
        events(spark, folder).select("transaction_id", F.col("event_ts").alias("read_ts")), "transaction_id"
    )
    decided = access_decisions(spark, reads)
    columns = "transaction_id long, principal string, role string, feature_view string, sensitivity string, read_ts timestamp"
    log = AuditLog(spark, work_folder(spark, "audit"), columns)
    for batch in (0, 1, 1, 2):
        log.append(decided.where(F.col("transaction_id") % 3 == batch), f"reads-{batch}")
    found = log.read(at("2024-01-08"), at("2024-01-15"))
    return found.select("transaction_id", "principal", "feature_view", plain("read_ts").alias("read_ts"), "batch")


AUDIT_LOG = f"""WITH {DECIDED}
SELECT transaction_id, principal, feature_view, event_ts AS read_ts, 'reads-' || (transaction_id % 3) AS batch
FROM d JOIN (SELECT transaction_id, event_ts FROM events_t) USING (transaction_id)
WHERE allowed AND must_audit AND event_ts >= TIMESTAMP '2024-01-08' AND event_ts < TIMESTAMP '2024-01-15'"""


def sensitive_reads(spark, folder):
    """Reads per view that needs auditing."""
    levels = spark.createDataFrame(VIEW_LEVELS, "feature_view string, sensitivity string")
    reads = _requests(spark, folder).groupBy("feature_view").agg(F.count(F.lit(1)).alias("reads"))
    return sensitive_views(levels).join(reads, "feature_view")


SENSITIVE_READS = f"""WITH {DECIDED}
SELECT feature_view, sensitivity, count(*) AS reads FROM r WHERE sensitivity <> 'public' GROUP BY ALL"""


def erase(spark, folder):
    """Big spenders ask to be forgotten: audit rows, and what is left in each table."""
    root, txns = work_folder(spark, "erase"), events(spark, folder)
    pair = entity_id({"user_id": F.col("user_id"), "merchant_id": F.concat(F.lit("m"), "merchant_id")})
    by_user = txns.select(F.col("user_id").alias("entity_id"), "event_ts", "amount")
    by_pair = txns.select(pair.alias("entity_id"), "event_ts", "amount")
    offline = []
    for name, rows in (("user_activity_v1", by_user), ("pair_activity_v1", by_pair)):
        made = FeatureTable(spark, f"{root}/offline", name, "amount double")
        made.upsert(rows.withColumn("created_ts", F.col("event_ts")))
        offline.append(made)
    online = LatestTable(spark, f"{root}/online", "user_activity_v1", "amount double")
    online.write(latest_per_entity(by_user), at("2024-01-31"), timedelta(days=7))
    requests = by_user.where("amount > 250").select("entity_id")
    audit = erase_entities(
        spark,
        requests,
        offline=offline,
        online=[online],
        audit_folder=f"{root}/audit",
        erased_at=at("2024-02-01"),
    )
    out = audit.select("entity_id", "store", "feature_view", "rows_deleted", F.lit(None).alias("left"))
    for store, name, rows in (
        ("offline", "user_activity_v1", offline[0].read_range(at("2024-01-01"), at("2024-02-01"))),
        ("offline", "pair_activity_v1", offline[1].read_range(at("2024-01-01"), at("2024-02-01"))),
        ("online", "user_activity_v1", online.rows()),
    ):
        out = out.unionByName(
            rows.agg(F.count(F.lit(1)).alias("left")).select(
                F.lit("*").alias("entity_id"),
                F.lit(store).alias("store"),
                F.lit(name).alias("feature_view"),
                F.lit(None).cast("long").alias("rows_deleted"),
                "left",
            )
        )
    return out


ERASE = f"""WITH {EVENT_TXNS}, gone AS (SELECT DISTINCT user_id FROM events_t WHERE amount > 250),
c AS (SELECT user_id, count(*) AS n FROM events_t GROUP BY user_id)
SELECT user_id AS entity_id, 'offline' AS store, 'user_activity_v1' AS feature_view,
       n AS rows_deleted, CAST(NULL AS BIGINT) AS "left" FROM gone JOIN c USING (user_id)
UNION ALL SELECT user_id, 'offline', 'pair_activity_v1', n, NULL FROM gone JOIN c USING (user_id)
UNION ALL SELECT user_id, 'online', 'user_activity_v1', 1, NULL FROM gone
UNION ALL SELECT '*', 'offline', v, NULL, (SELECT count(*) FROM events_t ANTI JOIN gone USING (user_id))
  FROM (VALUES ('user_activity_v1'), ('pair_activity_v1')) t(v)
UNION ALL SELECT '*', 'online', 'user_activity_v1', NULL,
  (SELECT count(*) FROM c ANTI JOIN gone USING (user_id))"""


def _done_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days with more purchases than views count as completed, the others as failed."""
    kind = F.col("event_type")
    balance = F.count(F.when(kind == "purchase", 1)) > F.count(F.when(kind == "view", 1))
    return events(spark, folder).groupBy(F.to_date("event_ts").alias("partition_date")).agg(
        F.lit("user_activity_v1").alias("feature_view"),
        F.when(balance, "completed").otherwise("failed").alias("status"),
    )


def backfill_plan(spark, folder):
    days = partition_days(spark, date(2023, 12, 28), date(2024, 2, 2))
    todo = pending_days(days, _done_days(spark, folder), "user_activity_v1")
    return todo.select(F.col("partition_date").cast("string").alias("partition_date"))


BACKFILL_PLAN = f"""WITH {EVENT_TXNS}, done AS (
  SELECT CAST(event_ts AS DATE) AS d FROM events_t GROUP BY 1
  HAVING count(*) FILTER (event_type = 'purchase') > count(*) FILTER (event_type = 'view'))
SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS partition_date
FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) s(g)
WHERE CAST(g AS DATE) NOT IN (SELECT d FROM done)"""

ACTIVITY_FEATURES = (
    "txn_count_30d long, txn_amount_sum_30d double, txn_amount_avg_30d double,"
    " distinct_merchants_30d long"
)


def _backfilled(spark: SparkSession, folder: str) -> tuple[FeatureTable, BackfillLog]:
    """A dry run, a first week, then the whole span: the last run computes only what is missing."""
    root = work_folder(spark, "backfill")
    stored = FeatureTable(spark, root, "user_activity_v1", ACTIVITY_FEATURES)
    log, txns = BackfillLog(spark, f"{root}/state"), events(spark, folder)

    def compute(days: list[date]) -> DataFrame:
        return user_activity_by_day(txns, days)

    options = {"requested_by": "ops", "now": at("2024-02-01"), "days_per_job": 10}
    run_backfill(log, stored, date(2024, 1, 1), date(2024, 1, 25), compute, dry_run=True, **options)
    run_backfill(log, stored, date(2024, 1, 1), date(2024, 1, 7), compute, **options)
    run_backfill(log, stored, date(2024, 1, 1), date(2024, 1, 25), compute, **options)
    return stored, log


def backfill_run(spark, folder):
    stored, _ = _backfilled(spark, folder)
    rows = stored.read_range(at("2024-01-01"), at("2024-02-01"))
    return rows.drop("created_ts").withColumns(
        {"event_ts": plain("event_ts"), "event_date": F.col("event_date").cast("string")}
    )


ACTIVITY_CTE = f"""{EVENT_TXNS}, days AS (
  SELECT CAST(g AS TIMESTAMP) AS d
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-25', INTERVAL 1 DAY) s(g)),
act AS (
  SELECT user_id AS entity_id, d AS event_ts, count(*) AS txn_count_30d,
         {exact('amount')} AS txn_amount_sum_30d,
         {exact('amount')} / count(amount) AS txn_amount_avg_30d,
         count(DISTINCT merchant_id) AS distinct_merchants_30d
  FROM events_t JOIN days ON event_ts <= d AND event_ts >= d - INTERVAL 30 DAYS GROUP BY ALL)"""
BACKFILL_RUN = f"""WITH {ACTIVITY_CTE}
SELECT *, CAST(CAST(event_ts AS DATE) AS VARCHAR) AS event_date FROM act"""


def backfill_runs_rollup(spark, folder):
    _, log = _backfilled(spark, folder)
    return run_rollup(log.runs(), log.partitions()).drop("run_id")


BACKFILL_RUNS_ROLLUP = f"""WITH {ACTIVITY_CTE}
SELECT 'user_activity_v1' AS feature_view, 'pending' AS status, CAST(0 AS BIGINT) AS partitions_done,
       CAST(0 AS BIGINT) AS rows_written
UNION ALL SELECT 'user_activity_v1', 'completed', 7,
  (SELECT count(*) FROM act WHERE event_ts <= TIMESTAMP '2024-01-07')
UNION ALL SELECT 'user_activity_v1', 'completed', 18,
  (SELECT count(*) FROM act WHERE event_ts > TIMESTAMP '2024-01-07')"""

QUERIES = {
    "access_decisions": access_decisions_,
    "access_audit": access_audit_,
    "audit_log": audit_log,
    "sensitive_reads": sensitive_reads,
    "erase": erase,
    "backfill_plan": backfill_plan,
    "backfill_run": backfill_run,
    "backfill_runs_rollup": backfill_runs_rollup,
}
ORACLES = {
    "access_decisions": ACCESS_DECISIONS,
    "access_audit": ACCESS_AUDIT,
    "audit_log": AUDIT_LOG,
    "sensitive_reads": SENSITIVE_READS,
    "erase": ERASE,
    "backfill_plan": BACKFILL_PLAN,
    "backfill_run": BACKFILL_RUN,
    "backfill_runs_rollup": BACKFILL_RUNS_ROLLUP,
}
