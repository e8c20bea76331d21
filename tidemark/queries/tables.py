"""Feature-table and latest-table queries: each writes tables derived from the data, then reads them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.health import hot_entities
from tidemark.operators.quality import Contract, ContractColumn, Expectation, contract_report
from tidemark.plans.materialize import materialize_view, materialize_views
from tidemark.plans.training import service_training_set
from tidemark.plans.views import MERCHANT_FEATURES, PAIR_FEATURES, SERVICES, USER_FEATURES
from tidemark.queries.batch import (
    AS_OF,
    MERCHANT_SQL,
    MERCHANTS_SQL,
    PAIR_SQL,
    USER_SQL,
    USERS_SQL,
    _merchants,
    merchant_rows,
    pair_rows,
    user_rows,
)
from tidemark.queries.common import EVENT_TXNS, LINE_TXNS, at, events, plain, stored_lines
from tidemark.session import work_folder
from tidemark.sources.feature_table import FeatureTable, instant, latest_per_entity, utc
from tidemark.sources.latest_table import LatestTable, expiry_by_tier, lookup, lookup_vectors, prewarm

ACTIVITY = "amount double, merchant_id string"
NOW = at("2000-07-01")
USER_CTES = f"{LINE_TXNS}, {USERS_SQL}, u AS ({USER_SQL})"


def activity_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a feature row of its user."""
    return events(spark, folder).select(
        F.col("user_id").alias("entity_id"),
        "event_ts",
        "amount",
        "merchant_id",
        F.col("event_ts").alias("created_ts"),
        "event_type",
    )


def activity_table(spark: SparkSession, folder: str, purpose: str) -> FeatureTable:
    stored = FeatureTable(spark, work_folder(spark, purpose), "user_activity_v1", ACTIVITY)
    stored.upsert(activity_rows(spark, folder))
    return stored


def _rows_out(df: DataFrame) -> DataFrame:
    return df.select(
        "entity_id",
        plain("event_ts").alias("event_ts"),
        "amount",
        "merchant_id",
        plain("created_ts").alias("created_ts"),
        F.col("event_date").cast("string").alias("event_date"),
    )


ROWS_SQL = """entity_id, event_ts, amount, merchant_id, created_ts,
       CAST(CAST(event_ts AS DATE) AS VARCHAR) AS event_date"""
ACTIVITY_SQL = f"""{EVENT_TXNS}, act AS (
  SELECT user_id AS entity_id, event_ts, amount, merchant_id, event_ts AS created_ts, event_type
  FROM events_t)"""


def read_range(spark, folder):
    stored = activity_table(spark, folder, "range")
    return _rows_out(stored.read_range(at("2024-01-10"), at("2024-01-20T12:00:00")))


READ_RANGE = f"""WITH {ACTIVITY_SQL} SELECT {ROWS_SQL} FROM act
WHERE event_ts >= TIMESTAMP '2024-01-10' AND event_ts < TIMESTAMP '2024-01-20 12:00:00'"""


def upsert_dedup(spark, folder):
    """Hourly rows merged in three writes; the last repeats the second and changes nothing."""
    hourly = activity_rows(spark, folder).withColumn("event_ts", F.date_trunc("hour", "event_ts"))
    stored = FeatureTable(spark, work_folder(spark, "upsert"), "user_hours_v1", ACTIVITY)
    stored.upsert(hourly.where("event_type <> 'error'"))
    corrected = hourly.where("event_type IN ('error', 'purchase')").withColumn(
        "amount", F.col("amount") + 1
    )
    stored.upsert(corrected)
    stored.upsert(corrected)
    return _rows_out(stored.read_range(at("2024-01-01"), at("2024-02-01")))


UPSERT_DEDUP = f"""WITH {ACTIVITY_SQL}, v AS (
  SELECT * REPLACE (date_trunc('hour', event_ts) AS event_ts), 0 AS prio FROM act
  WHERE event_type <> 'error'
  UNION ALL SELECT * REPLACE (date_trunc('hour', event_ts) AS event_ts, amount + 1 AS amount),
    1 AS prio FROM act WHERE event_type IN ('error', 'purchase'))
SELECT {ROWS_SQL} FROM v
QUALIFY row_number() OVER (PARTITION BY entity_id, event_ts ORDER BY created_ts DESC, prio DESC) = 1"""


def snapshot_read(spark, folder):
    """Daily rows with every version kept, read as they stood at noon of the 15th."""
    daily = activity_rows(spark, folder).withColumn("event_ts", F.date_trunc("day", "event_ts"))
    stored = FeatureTable(spark, work_folder(spark, "versions"), "user_days_v1", ACTIVITY)
    stored.append_versions(daily)
    seen = stored.known_at(at("2024-01-15T12:00:00"), at("2024-01-05"), at("2024-01-20"))
    return _rows_out(seen)


SNAPSHOT_READ = f"""WITH {ACTIVITY_SQL}, v AS (
  SELECT * REPLACE (date_trunc('day', event_ts) AS event_ts) FROM act)
SELECT {ROWS_SQL} FROM v WHERE created_ts <= TIMESTAMP '2024-01-15 12:00:00'
  AND event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY entity_id, event_ts ORDER BY created_ts DESC) = 1"""


def retention(spark, folder):
    stored = activity_table(spark, folder, "retention")
    stored.expire(date(2024, 1, 31), days=10)
    return _rows_out(stored.read_range(at("2024-01-01"), at("2024-02-01")))


RETENTION = f"""WITH {ACTIVITY_SQL} SELECT {ROWS_SQL} FROM act
WHERE event_ts >= TIMESTAMP '2024-01-21'"""


def partition_counts(spark, folder):
    counts = activity_table(spark, folder, "counts").partition_counts()
    return counts.select(F.col("event_date").cast("string").alias("event_date"), "rows")


PARTITION_COUNTS = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS rows
FROM events GROUP BY ALL"""


def latest_ts(spark, folder):
    newest = activity_table(spark, folder, "newest").latest_event_ts()
    return newest.select(plain("latest_event_ts").alias("latest_event_ts"))


LATEST_TS = "SELECT max(ts) AS latest_event_ts FROM events"

CONTRACT = Contract(
    "warehouse.transactions",
    4,
    (
        ContractColumn("transaction_id", "bigint", nullable=False),
        ContractColumn("user_id", "bigint", nullable=False),
        ContractColumn("amount", "double"),
        ContractColumn("merchant_country", "string", nullable=False),
        ContractColumn("currency", "string"),
        ContractColumn("event_ts", "timestamp", nullable=False),
    ),
    freshness="6h",
)


def contract_check(spark, folder):
    txns = events(spark, folder).select(
        "transaction_id", "user_id", "merchant_id", "amount", "event_ts"
    )
    known = txns.join(_merchants(spark, folder), "merchant_id", "left")
    return contract_report(known, CONTRACT, at("2024-01-31T05:00:00"))


CONTRACT_CHECK = f"""WITH {EVENT_TXNS}, {MERCHANTS_SQL}, f AS (
  SELECT count(*) FILTER (merchant_country IS NULL) AS n, max(event_ts) AS newest
  FROM events_t LEFT JOIN merchants_t USING (merchant_id)), c AS (
  SELECT 'transaction_id' AS item, 'type' AS "check", 0 AS violations, TRUE AS ok
  UNION ALL SELECT 'transaction_id', 'not_null', 0, TRUE
  UNION ALL SELECT 'user_id', 'type', 1, FALSE
  UNION ALL SELECT 'user_id', 'not_null', 0, TRUE
  UNION ALL SELECT 'amount', 'type', 0, TRUE
  UNION ALL SELECT 'merchant_country', 'type', 0, TRUE
  UNION ALL SELECT 'merchant_country', 'not_null', n, n = 0 FROM f
  UNION ALL SELECT 'currency', 'removed', 1, FALSE
  UNION ALL SELECT 'event_ts', 'type', 0, TRUE
  UNION ALL SELECT 'event_ts', 'not_null', 0, TRUE
  UNION ALL SELECT 'merchant_id', 'undeclared', 0, TRUE
  UNION ALL SELECT 'event_ts', 'freshness', CAST(newest < TIMESTAMP '2024-01-30 23:00:00' AS INT),
    newest >= TIMESTAMP '2024-01-30 23:00:00' FROM f)
SELECT 'warehouse.transactions.v4' AS contract, item, "check", CAST(violations AS BIGINT)
  AS violations, ok FROM c"""


def latest_per_entity_(spark, folder):
    newest = latest_per_entity(activity_rows(spark, folder).drop("event_type"))
    return newest.withColumns(
        {"event_ts": plain("event_ts"), "created_ts": plain("created_ts")}
    )


LATEST_PER_ENTITY = f"""WITH {ACTIVITY_SQL}
SELECT entity_id, event_ts, amount, merchant_id, created_ts FROM act
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_ts DESC) = 1"""


def _stored_views(spark: SparkSession, folder: str, root: str) -> dict[str, FeatureTable]:
    """User, merchant and pair features of two dates in their tables."""
    made, txns = {}, stored_lines(spark, folder)
    for view, rows in (
        (USER_FEATURES, user_rows),
        (MERCHANT_FEATURES, merchant_rows),
        (PAIR_FEATURES, pair_rows),
    ):
        made[view.name] = FeatureTable(spark, f"{root}/offline", view.name, view.features)
        for day in ("2000-06-15", AS_OF):
            made[view.name].upsert(rows(spark, folder, day, txns))
    return made


def training_service(spark, folder):
    """A service's two views, each on its own key, joined to order lines around and after their day."""
    tables, txns = {}, stored_lines(spark, folder)
    for view, rows in ((USER_FEATURES, user_rows), (MERCHANT_FEATURES, merchant_rows)):
        root = work_folder(spark, "service")
        tables[view.name] = FeatureTable(spark, root, view.name, view.features)
        tables[view.name].upsert(rows(spark, folder, AS_OF, txns))
    spine = txns.where(
        (F.col("event_ts") >= instant(at("2000-06-20"))) & (F.col("event_ts") < instant(at("2001-01-20")))
    )
    spine = spine.select("transaction_id.l_linenumber", "user_id", "merchant_id", "event_ts")
    made = service_training_set(spine, "underwriting_v1", tables)
    return made.rows.select(
        *spine.columns[:3],
        plain("event_ts").alias("event_ts"),
        "account_age_days",
        "home_country",
        "merchant_age_days",
        "refund_rate_30d",
    )


TRAINING_SERVICE = f"""WITH {LINE_TXNS}, {USERS_SQL}, u AS ({USER_SQL}), m AS ({MERCHANT_SQL}), s AS (
  SELECT *, event_ts - TIMESTAMP '{AS_OF}' AS age FROM lines_t
  WHERE event_ts >= TIMESTAMP '2000-06-20' AND event_ts < TIMESTAMP '2001-01-20')
SELECT l_linenumber, user_id, merchant_id, s.event_ts,
  CASE WHEN age BETWEEN INTERVAL 0 DAYS AND INTERVAL 90 DAYS THEN account_age_days END
    AS account_age_days,
  CASE WHEN age BETWEEN INTERVAL 0 DAYS AND INTERVAL 90 DAYS THEN home_country END AS home_country,
  CASE WHEN age BETWEEN INTERVAL 0 DAYS AND INTERVAL 180 DAYS THEN merchant_age_days END
    AS merchant_age_days,
  CASE WHEN age BETWEEN INTERVAL 0 DAYS AND INTERVAL 180 DAYS THEN refund_rate_30d END
    AS refund_rate_30d
FROM s LEFT JOIN u ON u.entity_id = s.user_id LEFT JOIN m ON m.entity_id = s.merchant_id"""


def materialize_views_(spark, folder):
    """All three views of June into latest tables, twice; the rerun overwrites the same rows."""
    root = work_folder(spark, "materialize")
    sources = _stored_views(spark, folder, root)
    views = {v.name: v for v in (USER_FEATURES, MERCHANT_FEATURES, PAIR_FEATURES)}
    targets = {n: LatestTable(spark, f"{root}/online", n, v.features) for n, v in views.items()}
    window = (at("2000-06-01"), at("2000-07-01"))
    materialize_views(sources, targets, views, *window, now=NOW)
    counts = materialize_views(sources, targets, views, *window, now=NOW)
    lives = None
    for name, target in targets.items():
        spans = target.rows().groupBy(F.lit(name).alias("feature_view")).agg(
            F.count(F.lit(1)).alias("rows_stored"),
            plain(F.min("expires_at")).alias("expires_at"),
        )
        lives = spans if lives is None else lives.unionByName(spans)
    return counts.join(lives, "feature_view")


EARLY = "2000-06-15"


def _early(sql: str) -> str:
    return sql.replace(AS_OF, EARLY)


MATERIALIZE_VIEWS = f"""WITH {LINE_TXNS}, {USERS_SQL}, ids AS (
  SELECT 'user_features_v2' AS feature_view, 90 AS days, entity_id FROM ({USER_SQL})
  UNION SELECT 'user_features_v2', 90, entity_id FROM ({_early(USER_SQL)})
  UNION SELECT 'merchant_features_v1', 180, entity_id FROM ({MERCHANT_SQL})
  UNION SELECT 'merchant_features_v1', 180, entity_id FROM ({_early(MERCHANT_SQL)})
  UNION SELECT 'user_merchant_features_v1', 90, entity_id FROM ({PAIR_SQL})
  UNION SELECT 'user_merchant_features_v1', 90, entity_id FROM ({_early(PAIR_SQL)}))
SELECT feature_view, count(*) AS rows_written, count(*) AS rows_stored,
       TIMESTAMP '2000-07-01' + to_days(any_value(days)) AS expires_at
FROM ids GROUP BY feature_view"""


def _user_latest(spark: SparkSession, root: str) -> LatestTable:
    return LatestTable(spark, root, USER_FEATURES.name, USER_FEATURES.features)


def online_lookup(spark, folder):
    """Every later order line asks for its user's and merchant's features; merchants have expired."""
    root = work_folder(spark, "lookup")
    users, txns = _user_latest(spark, root), stored_lines(spark, folder)
    users.write(user_rows(spark, folder, txns=txns), NOW, USER_FEATURES.ttl)
    merchants = LatestTable(spark, root, MERCHANT_FEATURES.name, MERCHANT_FEATURES.features)
    merchants.write(merchant_rows(spark, folder, txns=txns), at(AS_OF), timedelta(hours=12))
    requests = txns.where(F.col("event_ts") > F.lit(AS_OF).cast("timestamp"))
    requests = requests.select("transaction_id.*", "user_id", "merchant_id")
    found = lookup(
        requests,
        [(users, ["user_id"]), (merchants, ["merchant_id"])],
        NOW,
        services=SERVICES,
        service="underwriting_v1",
    )
    return found.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "user_id",
        "txn_count_30d",
        "home_country",
        "avg_ticket_size",
        F.col("user_features_v2__status").cast("long").alias("user_status"),
        F.col("merchant_features_v1__status").cast("long").alias("merchant_status"),
    )


ONLINE_LOOKUP = f"""WITH {USER_CTES}, m AS ({MERCHANT_SQL})
SELECT l_orderkey, l_linenumber, l_extendedprice, l.user_id, txn_count_30d, home_country,
       CAST(NULL AS DOUBLE) AS avg_ticket_size,
       CAST(CASE WHEN u.entity_id IS NULL THEN 2 ELSE 1 END AS BIGINT) AS user_status,
       CAST(CASE WHEN m.entity_id IS NULL THEN 2 ELSE 3 END AS BIGINT) AS merchant_status
FROM lines_t l LEFT JOIN u ON l.user_id = u.entity_id LEFT JOIN m ON l.merchant_id = m.entity_id
WHERE event_ts > TIMESTAMP '{AS_OF}'"""


def extend_ttl(spark, folder):
    """Rows rewritten later are still live three hours on; only active ones among them are extended."""
    users = _user_latest(spark, work_folder(spark, "extend"))
    rows = user_rows(spark, folder)
    users.write(rows, at("2000-07-01T00:00:00"), timedelta(hours=1))
    again = rows.where("chargeback_rate_90d > 0")
    users.write(again, at("2000-07-01T02:00:00"), timedelta(hours=10))
    active = rows.where("txn_count_30d > 0")
    users.extend_ttl(active, at("2000-07-01T03:00:00"), timedelta(hours=24))
    stored = users.rows()
    return stored.select("entity_id", *[plain(c).alias(c) for c in ("written_ts", "expires_at")])


EXTEND_TTL = f"""WITH {USER_CTES}
SELECT entity_id, CASE WHEN chargeback_rate_90d > 0 THEN TIMESTAMP '2000-07-01 02:00:00'
         ELSE TIMESTAMP '2000-07-01 00:00:00' END AS written_ts,
       CASE WHEN chargeback_rate_90d > 0 AND txn_count_30d > 0 THEN TIMESTAMP '2000-07-02 03:00:00'
         WHEN chargeback_rate_90d > 0 THEN TIMESTAMP '2000-07-01 12:00:00'
         ELSE TIMESTAMP '2000-07-01 01:00:00' END AS expires_at FROM u"""


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as reads: purchases and views read the user view, the rest the merchant view."""
    by_user = F.col("event_type").isin("purchase", "view")
    return events(spark, folder).select(
        F.when(by_user, "user_features_v2").otherwise("merchant_features_v1").alias("feature_view"),
        F.when(by_user, F.col("user_id")).otherwise(F.col("merchant_id")).alias("entity_id"),
        "event_ts",
        "amount",
    )


READS_SQL = f"""{EVENT_TXNS}, reads AS (
  SELECT CASE WHEN event_type IN ('purchase', 'view') THEN 'user_features_v2'
           ELSE 'merchant_features_v1' END AS feature_view,
         CASE WHEN event_type IN ('purchase', 'view') THEN user_id ELSE merchant_id END AS entity_id,
         event_ts, amount FROM events_t),
hot AS (
  SELECT feature_view, entity_id, count(*) AS reads FROM reads
  GROUP BY feature_view, entity_id
  QUALIFY row_number() OVER (PARTITION BY feature_view ORDER BY count(*) DESC, entity_id) <= 20)"""


def hot_entities_(spark, folder):
    return hot_entities(read_log(spark, folder), 20)


HOT_ENTITIES = f"WITH {READS_SQL} SELECT feature_view, entity_id, reads FROM hot"
PEAK_NOW = "2024-01-30 23:45:00"


def prewarm_(spark, folder):
    """Hottest entities kept alive for a peak; each view's peak is when it was last read."""
    reads, root = read_log(spark, folder), work_folder(spark, "prewarm")
    tables = []
    for name in ("user_features_v2", "merchant_features_v1"):
        made = LatestTable(spark, root, name, "amount double")
        newest = latest_per_entity(reads.where(F.col("feature_view") == name).drop("feature_view"))
        made.write(newest, F.col("event_ts"), timedelta(days=1))
        tables.append(made)
    peaks = reads.groupBy("feature_view").agg(F.max("event_ts").alias("start_ts"))
    prewarm(tables, peaks, hot_entities(reads, 20), at(PEAK_NOW))
    out = None
    for made in tables:
        rows = made.rows().select(
            F.lit(made.name).alias("feature_view"), "entity_id", plain("expires_at").alias("expires_at")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


PREWARM = f"""WITH {READS_SQL}, last AS (
  SELECT feature_view, entity_id, max(event_ts) AS seen FROM reads GROUP BY ALL),
peak AS (SELECT feature_view, max(event_ts) AS start_ts FROM reads GROUP BY ALL)
SELECT l.feature_view, l.entity_id,
  CASE WHEN h.entity_id IS NOT NULL AND seen + INTERVAL 1 DAY > TIMESTAMP '{PEAK_NOW}'
    AND start_ts BETWEEN TIMESTAMP '{PEAK_NOW}' AND TIMESTAMP '{PEAK_NOW}' + INTERVAL 30 MINUTES
    THEN TIMESTAMP '{PEAK_NOW}' + INTERVAL 6 HOURS ELSE seen + INTERVAL 1 DAY END AS expires_at
FROM last l JOIN peak p USING (feature_view)
LEFT JOIN hot h ON l.feature_view = h.feature_view AND l.entity_id = h.entity_id"""


def tiers(spark, folder):
    """Hot entities live a day, the others a week, counted from their last read."""
    reads = read_log(spark, folder)
    hot = hot_entities(reads, 20).select("feature_view", "entity_id", F.lit("hot").alias("_tier"))
    newest = reads.groupBy("feature_view", "entity_id").agg(F.max("event_ts").alias("_seen"))
    tier = F.coalesce("_tier", F.lit("cold"))
    return newest.join(hot, ["feature_view", "entity_id"], "left").select(
        "feature_view",
        "entity_id",
        tier.alias("tier"),
        plain(expiry_by_tier(F.col("_seen"), tier)).alias("expires_at"),
    )


TIERS = f"""WITH {READS_SQL}, last AS (
  SELECT feature_view, entity_id, max(event_ts) AS seen FROM reads GROUP BY ALL)
SELECT l.feature_view, l.entity_id, CASE WHEN h.reads IS NULL THEN 'cold' ELSE 'hot' END AS tier,
       seen + CASE WHEN h.reads IS NULL THEN INTERVAL 7 DAYS ELSE INTERVAL 1 DAY END AS expires_at
FROM last l LEFT JOIN hot h ON l.feature_view = h.feature_view AND l.entity_id = h.entity_id"""


def gated_materialize(spark, folder):
    """User features through the quality gate into the latest table, read back by entity."""
    root = work_folder(spark, "gate")
    source = FeatureTable(spark, f"{root}/offline", USER_FEATURES.name, USER_FEATURES.features)
    txns = stored_lines(spark, folder)
    source.upsert(user_rows(spark, folder, txns=txns))
    target = _user_latest(spark, f"{root}/online")
    rules = (
        Expectation("entity_id", "unique"),
        Expectation("chargeback_rate_90d", "between", {"min": 0.0, "max": 1.0}),
    )
    window = (at("2000-06-01"), at("2000-07-01"))
    materialize_view(source, target, *window, now=NOW, ttl=USER_FEATURES.ttl, gate=rules)
    wanted = txns.select(F.col("user_id").alias("entity_id")).distinct()
    return target.read(wanted, NOW).select("entity_id", "txn_count_30d", "txn_amount_sum_30d")


GATED_MATERIALIZE = f"""WITH {USER_CTES}
SELECT i.entity_id, txn_count_30d, txn_amount_sum_30d
FROM (SELECT DISTINCT user_id AS entity_id FROM lines_t) i LEFT JOIN u ON i.entity_id = u.entity_id"""

def snapshot_of_upserts(spark, folder):
    """The corrected table, and the same days as they were before the correction replaced them."""
    moments = iter(at(f"2024-03-0{i}T00:00:00") for i in (1, 2))
    hourly = activity_rows(spark, folder).withColumn("event_ts", F.date_trunc("hour", "event_ts"))
    stored = FeatureTable(
        spark, work_folder(spark, "snapshots"), "user_hours_v1", ACTIVITY, clock=lambda: utc(next(moments))
    )
    stored.upsert(hourly.where("event_type <> 'error'"))
    corrected = hourly.where("event_type IN ('error', 'purchase')").withColumn("amount", F.col("amount") + 1)
    stored.upsert(corrected)
    seen = [
        _rows_out(stored.snapshot(at(moment), at("2024-01-01"), at("2024-02-01"))).withColumn("seen", F.lit(name))
        for name, moment in (("before", "2024-03-01T12:00:00"), ("after", "2024-03-09T00:00:00"))
    ]
    return seen[0].unionByName(seen[1])


SNAPSHOT_OF_UPSERTS = f"""WITH {ACTIVITY_SQL}, v AS (
  SELECT * REPLACE (date_trunc('hour', event_ts) AS event_ts), 0 AS prio FROM act
  WHERE event_type <> 'error'
  UNION ALL SELECT * REPLACE (date_trunc('hour', event_ts) AS event_ts, amount + 1 AS amount),
    1 AS prio FROM act WHERE event_type IN ('error', 'purchase'))
SELECT {ROWS_SQL}, 'before' AS seen FROM v WHERE prio = 0
QUALIFY row_number() OVER (PARTITION BY entity_id, event_ts ORDER BY created_ts DESC) = 1
UNION ALL SELECT {ROWS_SQL}, 'after' AS seen FROM v
QUALIFY row_number() OVER (PARTITION BY entity_id, event_ts ORDER BY created_ts DESC, prio DESC) = 1"""


def latest_deltas(spark, folder):
    """Five batches of events merged into the latest table, newest first; purchases live on, by deltas across two bases."""
    table = LatestTable(spark, work_folder(spark, "deltas"), "last_event_v1", "amount double, kind string", compact_after=3)
    rows = events(spark, folder).select(
        F.col("user_id").alias("entity_id"), "amount", F.col("event_type").alias("kind"), "event_ts", "transaction_id"
    )
    for turn in range(5):
        mine = rows.where(F.col("transaction_id") % 5 == turn).drop("transaction_id")
        table.write(mine, at(f"2024-03-01T0{turn}:00:00"), timedelta(hours=9), newest_wins=True, token=f"batch-{turn}")
    buyers = table.rows().where("kind = 'purchase'")
    table.extend_ttl(buyers, at("2024-03-01T05:00:00"), timedelta(days=1))
    stored = table.rows()
    return stored.select("entity_id", "amount", "kind", *[plain(c).alias(c) for c in ("event_ts", "written_ts", "expires_at")])


LATEST_DELTAS = f"""WITH {EVENT_TXNS}, newest AS (
  SELECT user_id AS entity_id, amount, event_type AS kind, event_ts,
         TIMESTAMP '2024-03-01 00:00:00' + to_hours(CAST(transaction_id % 5 AS INT)) AS written_ts
  FROM events_t
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, transaction_id % 5 DESC, amount DESC) = 1)
SELECT *, CASE WHEN kind = 'purchase' THEN TIMESTAMP '2024-03-02 05:00:00'
  ELSE written_ts + INTERVAL 9 HOURS END AS expires_at FROM newest"""


def lookup_vectors_(spark, folder):
    """The statuses and features of a lookup as maps, entry by entry."""
    root = work_folder(spark, "vectors")
    users, txns = _user_latest(spark, root), stored_lines(spark, folder)
    users.write(user_rows(spark, folder, txns=txns), NOW, USER_FEATURES.ttl)
    merchants = LatestTable(spark, root, MERCHANT_FEATURES.name, MERCHANT_FEATURES.features)
    merchants.write(merchant_rows(spark, folder, txns=txns), at(AS_OF), timedelta(hours=12))
    requests = txns.where(F.col("event_ts") > F.lit(AS_OF).cast("timestamp"))
    requests = requests.select("transaction_id.*", "user_id", "merchant_id").drop("l_extendedprice")
    packed = lookup_vectors(requests, [(users, ["user_id"]), (merchants, ["merchant_id"])], NOW)
    none = {"status": F.lit(None).cast("int"), "value": F.lit(None).cast("string")}

    def entries(column: str, name: str):
        kept = lambda e: none | {name: e["value"]}
        return F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("name"), *[c.alias(n) for n, c in kept(e).items()]))

    both = F.concat(entries("statuses", "status"), entries("text", "value"))
    return packed.select("l_orderkey", "l_linenumber", F.inline(both))


LOOKUP_VECTORS = f"""WITH {USER_CTES}, m AS ({MERCHANT_SQL}), found AS (
  SELECT l_orderkey, l_linenumber, u.entity_id AS u_id, m.entity_id AS m_id, u.home_country
  FROM lines_t l LEFT JOIN u ON l.user_id = u.entity_id LEFT JOIN m ON l.merchant_id = m.entity_id
  WHERE event_ts > TIMESTAMP '{AS_OF}')
SELECT l_orderkey, l_linenumber, 'user_features_v2' AS name,
  CASE WHEN u_id IS NULL THEN 2 ELSE 1 END AS status, CAST(NULL AS VARCHAR) AS value FROM found
UNION ALL SELECT l_orderkey, l_linenumber, 'merchant_features_v1', CASE WHEN m_id IS NULL THEN 2 ELSE 3 END, NULL FROM found
UNION ALL SELECT l_orderkey, l_linenumber, 'home_country', NULL, home_country FROM found WHERE home_country IS NOT NULL"""


QUERIES = {
    "training_service": training_service,
    "read_range": read_range,
    "upsert_dedup": upsert_dedup,
    "snapshot_read": snapshot_read,
    "snapshot_of_upserts": snapshot_of_upserts,
    "latest_deltas": latest_deltas,
    "lookup_vectors": lookup_vectors_,
    "retention": retention,
    "partition_counts": partition_counts,
    "latest_ts": latest_ts,
    "contract_check": contract_check,
    "latest_per_entity": latest_per_entity_,
    "materialize_views": materialize_views_,
    "gated_materialize": gated_materialize,
    "online_lookup": online_lookup,
    "extend_ttl": extend_ttl,
    "hot_entities": hot_entities_,
    "prewarm": prewarm_,
    "tiers": tiers,
}
ORACLES = {
    "training_service": TRAINING_SERVICE,
    "read_range": READ_RANGE,
    "upsert_dedup": UPSERT_DEDUP,
    "snapshot_read": SNAPSHOT_READ,
    "snapshot_of_upserts": SNAPSHOT_OF_UPSERTS,
    "latest_deltas": LATEST_DELTAS,
    "lookup_vectors": LOOKUP_VECTORS,
    "retention": RETENTION,
    "partition_counts": PARTITION_COUNTS,
    "latest_ts": LATEST_TS,
    "contract_check": CONTRACT_CHECK,
    "latest_per_entity": LATEST_PER_ENTITY,
    "materialize_views": MATERIALIZE_VIEWS,
    "gated_materialize": GATED_MATERIALIZE,
    "online_lookup": ONLINE_LOOKUP,
    "extend_ttl": EXTEND_TTL,
    "hot_entities": HOT_ENTITIES,
    "prewarm": PREWARM,
    "tiers": TIERS,
}
