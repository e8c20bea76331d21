"""Point-in-time queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_id
from tidemark.functions.scalars import is_within_ttl
from tidemark.operators.asof import AsOfView, leakage_audit, point_in_time_join
from tidemark.operators.batch_features import user_activity_by_day
from tidemark.operators.sampling import join_fanout, sample_rows
from tidemark.plans.training import build_training_set, manifest
from tidemark.queries.common import EVENT_TXNS, events, exact, plain
from tidemark.session import work_folder
from tidemark.sources.feature_table import FeatureTable, spine_range

LABEL_FROM = 50.0


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled spine: one row per purchase, the label saying whether it was large."""
    return events(spark, folder).where("event_type = 'purchase'").select(
        "transaction_id",
        F.col("user_id").alias("entity_id"),
        "user_id",
        "merchant_id",
        "event_ts",
        (F.col("amount") > LABEL_FROM).cast("long").alias("label"),
    )


def views(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows: what a user looked at, with its amount and merchant."""
    return events(spark, folder).where("event_type = 'view'").select(
        F.col("user_id").alias("entity_id"),
        "event_ts",
        F.col("amount").alias("view_amount"),
        F.col("merchant_id").alias("view_merchant"),
    )


def _spine(spark: SparkSession, folder: str) -> DataFrame:
    return purchases(spark, folder).select("transaction_id", "entity_id", "event_ts", "label")


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("event_ts", plain("event_ts"))


SPINE = EVENT_TXNS + f""",
spine AS (
  SELECT transaction_id, user_id AS entity_id, user_id, merchant_id, event_ts,
         CAST(amount > {LABEL_FROM} AS BIGINT) AS label
  FROM events_t WHERE event_type = 'purchase'),
feats AS (
  SELECT user_id AS entity_id, event_ts, amount AS view_amount, merchant_id AS view_merchant
  FROM events_t WHERE event_type = 'view')"""


def pit_basic(spark, folder):
    return _out(point_in_time_join(_spine(spark, folder), views(spark, folder)))


PIT_BASIC = f"""WITH {SPINE}
SELECT transaction_id, s.entity_id, s.event_ts, label, view_amount, view_merchant
FROM spine s ASOF LEFT JOIN feats f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts"""


def _with_ttl(spark, folder, **options):
    ttl = timedelta(days=2)
    joined = point_in_time_join(
        _spine(spark, folder), views(spark, folder), ttl=ttl, matched_ts="feature_ts", **options
    )
    fresh = F.coalesce(is_within_ttl(F.col("feature_ts"), F.col("event_ts"), ttl), F.lit(False))
    return _out(
        joined.withColumns({"fresh": fresh, "feature_ts": plain("feature_ts")})
    )


def pit_ttl(spark, folder):
    return _with_ttl(spark, folder)


def pit_two_phase(spark, folder):
    """The same with heavy keys from 16 rows on, so that every key goes through slices."""
    return _with_ttl(spark, folder, rows_per_slice=16)


PIT_TTL = f"""WITH {SPINE}, hit AS (
  SELECT transaction_id, s.entity_id, s.event_ts, label, view_amount, view_merchant,
         f.event_ts AS feature_ts, s.event_ts - f.event_ts <= INTERVAL 2 DAYS AS ok
  FROM spine s ASOF LEFT JOIN feats f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts)
SELECT transaction_id, entity_id, event_ts, label, CASE WHEN ok THEN view_amount END AS view_amount,
       CASE WHEN ok THEN view_merchant END AS view_merchant,
       CASE WHEN ok THEN feature_ts END AS feature_ts, COALESCE(ok, FALSE) AS fresh FROM hit"""


def pit_tie_created(spark, folder):
    """Features stamped with their day only: many versions per instant, the last written wins."""
    daily = views(spark, folder).withColumns(
        {"created_ts": F.col("event_ts"), "event_ts": F.date_trunc("day", "event_ts")}
    )
    return _out(point_in_time_join(_spine(spark, folder), daily))


PIT_TIE_CREATED = f"""WITH {SPINE}, daily AS (
  SELECT entity_id, date_trunc('day', event_ts) AS event_ts, view_amount, view_merchant
  FROM feats QUALIFY row_number() OVER (
    PARTITION BY entity_id, date_trunc('day', event_ts) ORDER BY event_ts DESC) = 1)
SELECT transaction_id, s.entity_id, s.event_ts, label, view_amount, view_merchant
FROM spine s ASOF LEFT JOIN daily f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts"""


def pit_composite(spark, folder):
    """Pair features by encoded composite id, over every non-purchase event of the pair."""
    pair = entity_id({"user_id": F.col("user_id"), "merchant_id": F.col("merchant_id")})
    spine = purchases(spark, folder).withColumn("entity_id", pair)
    features = (
        events(spark, folder)
        .where("event_type <> 'purchase'")
        .select(pair.alias("entity_id"), "event_ts", F.col("amount").alias("pair_amount"))
    )
    spine = spine.select("transaction_id", "entity_id", "event_ts", "label")
    return _out(point_in_time_join(spine, features))


PIT_COMPOSITE = f"""WITH {SPINE}, pairs AS (
  SELECT merchant_id || '|' || user_id AS entity_id, event_ts, amount AS pair_amount
  FROM events_t WHERE event_type <> 'purchase'),
s AS (SELECT transaction_id, merchant_id || '|' || user_id AS entity_id, event_ts, label FROM spine)
SELECT transaction_id, s.entity_id, s.event_ts, label, pair_amount
FROM s ASOF LEFT JOIN pairs f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts"""


def pit_dup_spine(spark, folder):
    """Every spine row twice: the result has exactly those rows, not their square."""
    spine = _spine(spark, folder)
    return _out(point_in_time_join(spine.unionByName(spine), views(spark, folder)))


PIT_DUP_SPINE = f"""WITH {SPINE}, twice AS (SELECT * FROM spine UNION ALL SELECT * FROM spine)
SELECT transaction_id, s.entity_id, s.event_ts, label, view_amount, view_merchant
FROM twice s ASOF LEFT JOIN feats f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts"""


def pit_null_keys(spark, folder):
    """All events as spine; sign-ups lose their entity and clicks their time."""
    spine = events(spark, folder).select(
        "transaction_id",
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("entity_id"),
        F.when(F.col("event_type") != "click", F.col("event_ts")).alias("event_ts"),
    )
    return _out(point_in_time_join(spine, views(spark, folder)))


PIT_NULL_KEYS = f"""WITH {SPINE}, s AS (
  SELECT transaction_id, CASE WHEN event_type <> 'signup' THEN user_id END AS entity_id,
         CASE WHEN event_type <> 'click' THEN event_ts END AS event_ts FROM events_t)
SELECT transaction_id, s.entity_id, s.event_ts, view_amount, view_merchant
FROM s ASOF LEFT JOIN feats f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts
WHERE s.entity_id IS NOT NULL AND s.event_ts IS NOT NULL
UNION ALL SELECT transaction_id, entity_id, event_ts, NULL, NULL FROM s
WHERE entity_id IS NULL OR event_ts IS NULL"""


def _kinds(spark: SparkSession, folder: str) -> dict[str, AsOfView]:
    """Three views on different keys: user, merchant, and the pair; two share a feature name."""
    txns = events(spark, folder)

    def rows(kind: str, feature: str, *keys: str) -> DataFrame:
        of_kind = txns.where(F.col("event_type") == kind)
        return of_kind.select(*keys, "event_ts", F.col("amount").alias(feature), "transaction_id")

    return {
        "user_views_v1": AsOfView(
            "user_views_v1",
            rows("view", "amount", "user_id"),
            ("user_id",),
            created_ts=None,
            ttl=timedelta(days=5),
            columns=("amount",),
        ),
        "user_errors_v1": AsOfView(
            "user_errors_v1",
            rows("error", "error_amount", "user_id"),
            ("user_id",),
            created_ts=None,
            ttl=timedelta(days=1),
            columns=("error_amount",),
        ),
        "merchant_clicks_v1": AsOfView(
            "merchant_clicks_v1",
            rows("click", "amount", "merchant_id"),
            ("merchant_id",),
            created_ts=None,
            ttl=timedelta(days=3),
            columns=("amount",),
        ),
        "pair_signups_v2": AsOfView(
            "pair_signups_v2",
            rows("signup", "signup_amount", "user_id", "merchant_id"),
            ("user_id", "merchant_id"),
            created_ts=None,
            columns=("signup_amount",),
        ),
    }


def _multi_view(spark: SparkSession, folder: str):
    spine = purchases(spark, folder).drop("entity_id")
    kinds = _kinds(spark, folder)
    return build_training_set(
        spine, kinds.values(), label="label", versions={"pair_signups_v2": 2}
    )


def pit_multi_view(spark, folder):
    return _out(_multi_view(spark, folder).rows)


PIT_MULTI_VIEW = f"""WITH {SPINE}, a AS (
  SELECT s.transaction_id, s.user_id, s.merchant_id, s.event_ts, label,
    CASE WHEN s.event_ts - f.event_ts <= INTERVAL 5 DAYS THEN f.amount END AS user_views_v1__amount
  FROM spine s ASOF LEFT JOIN (FROM events_t WHERE event_type = 'view') f
    ON s.user_id = f.user_id AND s.event_ts >= f.event_ts),
b AS (SELECT a.*,
    CASE WHEN a.event_ts - f.event_ts <= INTERVAL 1 DAY THEN f.amount END AS error_amount
  FROM a ASOF LEFT JOIN (FROM events_t WHERE event_type = 'error') f
    ON a.user_id = f.user_id AND a.event_ts >= f.event_ts),
c AS (SELECT b.*,
    CASE WHEN b.event_ts - f.event_ts <= INTERVAL 3 DAYS THEN f.amount END
      AS merchant_clicks_v1__amount
  FROM b ASOF LEFT JOIN (FROM events_t WHERE event_type = 'click') f
    ON b.merchant_id = f.merchant_id AND b.event_ts >= f.event_ts)
SELECT c.*, f.amount AS signup_amount
FROM c ASOF LEFT JOIN (FROM events_t WHERE event_type = 'signup') f
  ON c.user_id = f.user_id AND c.merchant_id = f.merchant_id AND c.event_ts >= f.event_ts"""


def manifest_rows(spark, folder):
    return manifest(_multi_view(spark, folder), service="fraud_scoring_v3", snapshot="2024-01-31")


MANIFEST = f"""WITH {SPINE}
SELECT name AS feature_view, CAST(version AS INTEGER) AS version,
       name || ':v' || version AS pinned, 'fraud_scoring_v3' AS service,
       '2024-01-31' AS snapshot_id, (SELECT count(*) FROM spine) AS row_count
FROM (VALUES ('user_views_v1', 1), ('user_errors_v1', 1), ('merchant_clicks_v1', 1),
             ('pair_signups_v2', 2)) v(name, version)"""


def pit_pushdown(spark, folder):
    """As-of against the stored, day-partitioned table; only days that can match are scanned."""
    feature_table = FeatureTable(
        spark, work_folder(spark, "pit"), "user_views_v1", "view_amount double, view_merchant string"
    )
    rows = views(spark, folder)
    feature_table.upsert(rows.withColumn("created_ts", F.col("event_ts")))
    spine = _spine(spark, folder).where(F.col("event_ts") >= F.lit("2024-01-15").cast("timestamp"))
    return _out(feature_table.as_of(spine, ttl=timedelta(days=2)))


def pit_spine_keys(spark, folder):
    """The same for purchases of every seventh user: other users' feature rows are left out before the shuffle."""
    feature_table = FeatureTable(
        spark, work_folder(spark, "pit"), "user_views_v1", "view_amount double, view_merchant string"
    )
    feature_table.upsert(views(spark, folder).withColumn("created_ts", F.col("event_ts")))
    spine = _spine(spark, folder).where(F.col("event_ts") >= F.lit("2024-01-15").cast("timestamp"))
    few = spine.where(F.col("entity_id").cast("int") % 7 == 0)
    return _out(feature_table.as_of(few, ttl=timedelta(days=2), spine_keys_only=True))


PIT_PUSHDOWN = f"""WITH {SPINE}, hit AS (
  SELECT transaction_id, s.entity_id, s.event_ts, label, view_amount, view_merchant,
         s.event_ts - f.event_ts <= INTERVAL 2 DAYS AS ok, row_number() OVER (
           PARTITION BY transaction_id ORDER BY f.event_ts DESC NULLS LAST) AS rn
  FROM spine s LEFT JOIN feats f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts
  WHERE s.event_ts >= TIMESTAMP '2024-01-15')
SELECT transaction_id, entity_id, event_ts, label, CASE WHEN ok THEN view_amount END AS view_amount,
       CASE WHEN ok THEN view_merchant END AS view_merchant FROM hit WHERE rn = 1"""


PIT_SPINE_KEYS = f"SELECT * FROM ({PIT_PUSHDOWN}) WHERE CAST(entity_id AS INT) % 7 = 0"


def pit_leakage_audit(spark, folder):
    joined = point_in_time_join(
        _spine(spark, folder), views(spark, folder), matched_ts="feature_ts"
    )
    return leakage_audit(joined, event_ts="event_ts", matched_ts="feature_ts")


PIT_LEAKAGE_AUDIT = f"""WITH {SPINE}
SELECT count(*) AS rows, count(f.event_ts) AS matched,
       CAST(count(*) FILTER (f.event_ts > s.event_ts) AS BIGINT) AS leaks
FROM spine s ASOF LEFT JOIN feats f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts"""


ACTIVITY = (
    "txn_count_30d long, txn_amount_sum_30d double, txn_amount_avg_30d double,"
    " distinct_merchants_30d long"
)


def training_set(spark, folder):
    """Daily user activity of the month into its table, then joined to the purchases as of theirs."""
    days = [date(2024, 1, d) for d in range(1, 32)]
    stored = FeatureTable(spark, work_folder(spark, "training"), "user_activity_v1", ACTIVITY)
    stored.replace_days(user_activity_by_day(events(spark, folder), days), days)
    return _out(stored.as_of(_spine(spark, folder), ttl=timedelta(days=7)))


TRAINING_SET = f"""WITH {SPINE}, days AS (
  SELECT CAST(d AS TIMESTAMP) AS d
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(d)),
activity AS (
  SELECT user_id AS entity_id, d AS event_ts, count(*) AS txn_count_30d,
         {exact('amount')} AS txn_amount_sum_30d,
         {exact('amount')} / count(amount) AS txn_amount_avg_30d,
         count(DISTINCT merchant_id) AS distinct_merchants_30d
  FROM events_t JOIN days ON event_ts <= d AND event_ts >= d - INTERVAL 30 DAYS GROUP BY ALL)
SELECT transaction_id, s.entity_id, s.event_ts, label, txn_count_30d, txn_amount_sum_30d,
       txn_amount_avg_30d, distinct_merchants_30d
FROM spine s ASOF LEFT JOIN activity f ON s.entity_id = f.entity_id AND s.event_ts >= f.event_ts"""


def training_sample(spark, folder):
    return _out(sample_rows(_spine(spark, folder), 0.2, seed=42))


TRAINING_SAMPLE = f"""WITH {SPINE}
SELECT transaction_id, entity_id, event_ts, label FROM spine
WHERE CAST('0x' || substr(md5('42:' || entity_id || ':' || epoch_us(event_ts)), 1, 8) AS UBIGINT)
      < {int(0.2 * 2**32)}"""


def join_fanout_(spark, folder):
    return join_fanout(_spine(spark, folder), views(spark, folder))


JOIN_FANOUT = f"""WITH {SPINE}
SELECT (SELECT count(DISTINCT entity_id) FROM spine) AS entities, count(*) AS feature_rows,
       count(*) / CAST((SELECT count(DISTINCT entity_id) FROM spine) AS DOUBLE) AS fanout
FROM feats WHERE entity_id IN (SELECT entity_id FROM spine)"""


def spine_range_(spark, folder):
    bounds = spine_range(_spine(spark, folder))
    return bounds.select(plain("start_ts").alias("start_ts"), plain("end_ts").alias("end_ts"))


SPINE_RANGE = f"""WITH {SPINE}
SELECT min(event_ts) AS start_ts, max(event_ts) AS end_ts FROM spine"""

QUERIES = {
    "pit_basic": pit_basic,
    "pit_ttl": pit_ttl,
    "pit_two_phase": pit_two_phase,
    "pit_tie_created": pit_tie_created,
    "pit_composite": pit_composite,
    "pit_dup_spine": pit_dup_spine,
    "pit_null_keys": pit_null_keys,
    "pit_multi_view": pit_multi_view,
    "pit_pushdown": pit_pushdown,
    "pit_spine_keys": pit_spine_keys,
    "pit_leakage_audit": pit_leakage_audit,
    "training_set": training_set,
    "training_sample": training_sample,
    "join_fanout": join_fanout_,
    "spine_range": spine_range_,
    "manifest": manifest_rows,
}
ORACLES = {
    "pit_basic": PIT_BASIC,
    "pit_ttl": PIT_TTL,
    "pit_two_phase": PIT_TTL,
    "pit_tie_created": PIT_TIE_CREATED,
    "pit_composite": PIT_COMPOSITE,
    "pit_dup_spine": PIT_DUP_SPINE,
    "pit_null_keys": PIT_NULL_KEYS,
    "pit_multi_view": PIT_MULTI_VIEW,
    "pit_pushdown": PIT_PUSHDOWN,
    "pit_spine_keys": PIT_SPINE_KEYS,
    "pit_leakage_audit": PIT_LEAKAGE_AUDIT,
    "training_set": TRAINING_SET,
    "training_sample": TRAINING_SAMPLE,
    "join_fanout": JOIN_FANOUT,
    "spine_range": SPINE_RANGE,
    "manifest": MANIFEST,
}
