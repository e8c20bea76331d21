"""Drift, skew, freshness, null rates, latency, alerts, data quality, usage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.drift import (
    baseline_and_current,
    baseline_due,
    stored_baseline,
    drift_report,
    drift_statistics,
    long_samples,
)
from tidemark.operators.health import (
    drift_findings,
    freshness,
    freshness_findings,
    latency_findings,
    latency_p99,
    low_usage_views,
    null_rates,
    paired,
    route_alerts,
    rows_per_minute,
    skew_findings,
    skew_report,
)
from tidemark.operators.quality import USER_FEATURE_RULES, Expectation, quality_report
from tidemark.operators.sums import double_sum
from tidemark.plans.stored_reports import stored_freshness, stored_null_rates
from tidemark.plans.views import VIEWS
from tidemark.queries.batch import USER_SQL, USERS_SQL, user_rows
from tidemark.queries.common import EVENT_TXNS, LINE_TXNS, at, events, exact, plain
from tidemark.queries.tables import READS_SQL, read_log
from tidemark.session import work_folder
from tidemark.sources.feature_table import FeatureTable

SPLIT, NOW = "2024-01-16", "2024-01-31 00:00:00"
FEATURES = ("amount", "merchant_no", "inflated", "constant")
USER_CTES = f"{LINE_TXNS}, {USERS_SQL}, u AS ({USER_SQL})"


def null_rates_(spark, folder):
    return null_rates(user_rows(spark, folder))


NULL_RATES = f"""WITH {USER_CTES}, r AS (SELECT
  avg(CAST(account_age_days IS NULL AS INT)) AS account_age_days,
  avg(CAST(txn_count_30d IS NULL AS INT)) AS txn_count_30d,
  avg(CAST(txn_amount_sum_30d IS NULL AS INT)) AS txn_amount_sum_30d,
  avg(CAST(txn_amount_avg_30d IS NULL AS INT)) AS txn_amount_avg_30d,
  avg(CAST(distinct_merchants_30d IS NULL AS INT)) AS distinct_merchants_30d,
  avg(CAST(chargeback_rate_90d IS NULL AS INT)) AS chargeback_rate_90d,
  avg(CAST(home_country IS NULL AS INT)) AS home_country FROM u)
SELECT feature, null_rate, null_rate > 0.05 AS breached
FROM (UNPIVOT r ON * INTO NAME feature VALUE null_rate)"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """First against second half of the month; one feature is inflated in the second half."""
    rows = events(spark, folder).select(
        "event_ts",
        "amount",
        F.col("merchant_id").cast("double").alias("merchant_no"),
        F.lit(7.0).alias("constant"),
    )
    later = F.col("event_ts") >= F.lit(SPLIT).cast("timestamp")
    baseline = rows.where(~later).withColumn("inflated", F.col("amount"))
    current = rows.where(later).withColumn("inflated", F.col("amount") * 1.5)
    return long_samples(baseline, current, FEATURES)


SAMPLES_SQL = f"""{EVENT_TXNS}, wide AS (
  SELECT event_ts < TIMESTAMP '{SPLIT}' AS base, amount, CAST(merchant_id AS DOUBLE) AS merchant_no,
         CASE WHEN event_ts < TIMESTAMP '{SPLIT}' THEN amount ELSE amount * 1.5 END AS inflated,
         7.0::DOUBLE AS constant FROM events_t),
vals AS (SELECT base, feature, value FROM (
  UNPIVOT wide ON amount, merchant_no, inflated, constant INTO NAME feature VALUE value)),
n AS (SELECT feature, count(*) FILTER (base) AS n_base, count(*) FILTER (NOT base) AS n_cur
  FROM vals GROUP BY feature),
ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r
  FROM vals WHERE base),
q AS (SELECT feature, (i * (n_base - 1)) // 10 AS lo, (i * (n_base - 1)) % 10 AS rest
  FROM n, range(11) t(i)),
edge AS (SELECT DISTINCT q.feature, a.value + (b.value - a.value) * (rest / 10.0::DOUBLE) AS e
  FROM q JOIN ranked a ON a.feature = q.feature AND a.r = lo
  JOIN ranked b ON b.feature = q.feature AND b.r = lo + CAST(rest > 0 AS INT)),
edges AS (SELECT feature, list_sort(list(e)) AS es FROM edge GROUP BY feature),
slotted AS (SELECT feature, base, CASE WHEN value = es[-1] THEN len(es) - 1
    ELSE len(list_filter(es, lambda x: x <= value)) END AS slot FROM vals JOIN edges USING (feature)),
counts AS (SELECT feature, slot, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS c
  FROM slotted GROUP BY feature, slot),
bins AS (SELECT feature, unnest(range(1, len(es))) AS slot FROM edges),
shares AS (SELECT bins.feature, greatest(COALESCE(b, 0) / CAST(n_base AS DOUBLE), 1e-6) AS e,
    greatest(COALESCE(c, 0) / CAST(n_cur AS DOUBLE), 1e-6) AS a
  FROM bins JOIN n ON bins.feature = n.feature
  LEFT JOIN counts ON counts.feature = bins.feature AND counts.slot = bins.slot),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY feature),
steps AS (SELECT DISTINCT feature, value,
    sum(CAST(base AS INT)) OVER w / CAST(n_base AS DOUBLE) AS f1,
    sum(CAST(NOT base AS INT)) OVER w / CAST(n_cur AS DOUBLE) AS f2
  FROM vals JOIN n USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(f1 - f2)) AS d FROM steps GROUP BY feature),
lam AS (SELECT feature, d, d * sqrt(n_base * n_cur / CAST(n_base + n_cur AS DOUBLE)) AS x
  FROM ks JOIN n USING (feature)),
kp AS (SELECT feature, d AS ks_stat, CASE WHEN x < 0.3 THEN 1 ELSE least(greatest(2 * list_sum(
    list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
      * exp(-2.0::DOUBLE * k * k * x * x))), 0), 1) END AS ks_pvalue FROM lam)"""


def psi(spark, folder):
    stats = drift_statistics(samples(spark, folder))
    return stats.select("feature", "n_base", "n_cur", F.round("psi", 9).alias("psi"))


PSI = f"""WITH {SAMPLES_SQL} SELECT feature, n_base, n_cur, round(COALESCE(psi, 0), 9) AS psi
FROM n LEFT JOIN psi USING (feature)"""


def ks(spark, folder):
    stats = drift_statistics(samples(spark, folder))
    return stats.select(
        "feature", F.round("ks_stat", 9).alias("ks_stat"), F.round("ks_pvalue", 9).alias("ks_pvalue")
    )


KS = f"""WITH {SAMPLES_SQL}
SELECT feature, round(ks_stat, 9) AS ks_stat, round(ks_pvalue, 9) AS ks_pvalue FROM kp"""


def drift_sliced(spark, folder):
    """The drift report with crowded features from 64 values on, so that all go through slices."""
    return _report(samples(spark, folder), rows_per_slice=64)


def _report(rows: DataFrame, **options) -> DataFrame:
    report = drift_report(rows, "user_activity_v1", **options)
    return report.withColumns({c: F.round(c, 9) for c in ("psi", "ks_stat", "ks_pvalue")})


def drift_report_(spark, folder):
    return _report(samples(spark, folder))


DRIFT_REPORT = f"""WITH {SAMPLES_SQL}, s AS (
  SELECT feature, n_base, n_cur, COALESCE(psi, 0) AS psi, ks_stat, ks_pvalue
  FROM n LEFT JOIN psi USING (feature) JOIN kp USING (feature))
SELECT 'user_activity_v1' AS feature_view, feature, n_base, n_cur, round(psi, 9) AS psi,
       round(ks_stat, 9) AS ks_stat, round(ks_pvalue, 9) AS ks_pvalue,
       CASE WHEN psi > 0.2 THEN 'alert' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END AS band,
       psi > 0.2 OR ks_pvalue < 0.05 AS alert FROM s"""


def baseline(spark, folder):
    """A month's baseline written beside the data and read back with the current day's sample."""
    today = date(2024, 1, 29)
    old, new = baseline_and_current(events(spark, folder), today, days=21)
    stored = work_folder(spark, "baseline")
    old.select("event_ts", "amount", "merchant_id").write.parquet(stored)
    both = (
        spark.read.parquet(stored)
        .withColumn("sample", F.lit("baseline"))
        .unionByName(
            new.select("event_ts", "amount", "merchant_id", F.lit("current").alias("sample"))
        )
    )
    due = baseline_due(date(2024, 1, 1), today)
    return both.groupBy("sample").agg(
        F.count(F.lit(1)).alias("rows"),
        double_sum("amount").alias("amount_sum"),
        F.count_distinct("merchant_id").alias("merchants"),
        F.lit(due).alias("due"),
    )


BASELINE = f"""WITH {EVENT_TXNS}
SELECT CASE WHEN event_ts < TIMESTAMP '2024-01-29' THEN 'baseline' ELSE 'current' END AS sample,
       count(*) AS rows, {exact('amount')} AS amount_sum,
       count(DISTINCT merchant_id) AS merchants, FALSE AS due
FROM events_t WHERE event_ts >= TIMESTAMP '2024-01-08' AND event_ts < TIMESTAMP '2024-01-30'
GROUP BY 1"""


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy(F.col("event_type").alias("feature_view")).agg(
        F.max("event_ts").alias("latest_event_ts")
    )


def _slas(spark: SparkSession) -> DataFrame:
    limits = [("click", "5m"), ("error", "1h"), ("purchase", "24h"), ("view", "2w"), ("none", "7d")]
    return spark.createDataFrame(limits, "feature_view string, sla string")


def freshness_(spark, folder):
    return freshness(_newest(spark, folder), _slas(spark), at(NOW))


FRESHNESS_CTE = f"""slas AS (SELECT * FROM (VALUES ('click', 300), ('error', 3600),
    ('purchase', 86400), ('view', 1209600), ('none', 604800)) v(feature_view, sla)),
newest AS (SELECT event_type AS feature_view, max(ts) AS latest FROM events GROUP BY event_type),
fresh AS (SELECT feature_view, COALESCE((epoch_us(TIMESTAMP '{NOW}') - epoch_us(latest)) / 1e6::DOUBLE,
    'Infinity'::DOUBLE) AS age_seconds, CAST(sla AS DOUBLE) AS sla_seconds
  FROM slas LEFT JOIN newest USING (feature_view))"""
FRESHNESS = f"""WITH {FRESHNESS_CTE}
SELECT *, age_seconds > sla_seconds AS breached FROM fresh"""
SKEWED = ("txn_count_30d", "txn_amount_sum_30d", "chargeback_rate_90d")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Online copy with inflated sums and without inactive users; offline without some merchants."""
    rows = user_rows(spark, folder).select("entity_id", *SKEWED)
    online = rows.where("txn_count_30d > 0").withColumn(
        "txn_amount_sum_30d", F.col("txn_amount_sum_30d") * 1.25
    )
    return paired(online, rows.where("chargeback_rate_90d < 0.5"), SKEWED)


def skew(spark, folder):
    report = skew_report(_pairs(spark, folder), SKEWED)
    return report.withColumn("skew", F.round("skew", 9))


SKEW_CTE = f"""{USER_CTES}, onl AS (
  SELECT entity_id, txn_count_30d AS c, txn_amount_sum_30d * 1.25 AS s, chargeback_rate_90d AS r
  FROM u WHERE txn_count_30d > 0),
ofl AS (SELECT entity_id, txn_count_30d AS c, txn_amount_sum_30d AS s, chargeback_rate_90d AS r
  FROM u WHERE chargeback_rate_90d < 0.5),
m AS (SELECT a.c AS c1, a.s AS s1, a.r AS r1, b.c AS c2, b.s AS s2, b.r AS r2
  FROM onl a JOIN ofl b USING (entity_id)),
sk AS (
  SELECT 'txn_count_30d' AS feature, avg(abs(c1 - c2)) / (abs(avg(c2)) + 1e-9) AS skew FROM m
  UNION ALL SELECT 'txn_amount_sum_30d', avg(abs(s1 - s2)) / (abs(avg(s2)) + 1e-9) FROM m
  UNION ALL SELECT 'chargeback_rate_90d', avg(abs(r1 - r2)) / (abs(avg(r2)) + 1e-9) FROM m)"""
SKEW = f"""WITH {SKEW_CTE}
SELECT feature, round(skew, 9) AS skew, (SELECT count(*) FROM m) AS n_compared,
       (SELECT count(*) FROM onl ANTI JOIN ofl USING (entity_id)) AS online_only,
       (SELECT count(*) FROM ofl ANTI JOIN onl USING (entity_id)) AS offline_only,
       skew > 0.1 AS alert FROM sk"""


def _latencies(spark: SparkSession, folder: str) -> DataFrame:
    return read_log(spark, folder).withColumn("latency_seconds", F.col("amount") / 5000)


def latency_p99_(spark, folder):
    p99 = latency_p99(_latencies(spark, folder))
    return p99.withColumns(
        {"window_start": plain("window_start"), "p99_seconds": F.round("p99_seconds", 9)}
    )


LATENCY_CTE = f"""{READS_SQL}, p AS (
  SELECT feature_view, time_bucket(INTERVAL 5 MINUTES, event_ts) AS window_start,
         count(*) AS reads, quantile_cont(amount / 5000, 0.99) AS p99 FROM reads
  GROUP BY feature_view, window_start)"""
LATENCY_P99 = f"""WITH {LATENCY_CTE}
SELECT feature_view, window_start, reads, round(p99, 9) AS p99_seconds, p99 > 0.01 AS breached FROM p"""


def rows_per_minute_(spark, folder):
    writes = read_log(spark, folder).select(
        "feature_view", F.col("event_ts").alias("written_ts"), F.lit(1).alias("rows")
    )
    counted = rows_per_minute(writes)
    return counted.withColumn("window_start", plain("window_start"))


ROWS_PER_MINUTE = f"""WITH {READS_SQL}
SELECT feature_view, date_trunc('minute', event_ts) AS window_start, count(*) AS rows
FROM reads GROUP BY feature_view, window_start"""


def alerts(spark, folder):
    return route_alerts(
        spark,
        drift_findings(drift_report(samples(spark, folder), "user_activity_v1")),
        freshness_findings(freshness(_newest(spark, folder), _slas(spark), at(NOW))),
        skew_findings(skew_report(_pairs(spark, folder), SKEWED), "user_features_v2"),
        latency_findings(latency_p99(_latencies(spark, folder))),
    )


ALERTS = f"""WITH {SAMPLES_SQL}, {FRESHNESS_CTE}, {LINE_TXNS}, {USERS_SQL}, u AS ({USER_SQL}),
{SKEW_CTE[len(USER_CTES) + 2:]}, {LATENCY_CTE[len(EVENT_TXNS) + 2:]}, found AS (
  SELECT 'user_activity_v1' AS feature_view, 'psi drift' AS title,
         CASE WHEN psi > 0.2 THEN 'ticket' ELSE 'slack' END AS severity, feature AS detail
  FROM psi WHERE psi >= 0.1
  UNION ALL SELECT feature_view, 'stale', 'page', 'older than its limit' FROM fresh
    WHERE age_seconds > sla_seconds
  UNION ALL SELECT 'user_features_v2', 'serving skew', 'ticket', feature FROM sk WHERE skew > 0.1
  UNION ALL SELECT DISTINCT feature_view, 'slow reads', 'page', 'p99 above limit' FROM p
    WHERE p99 > 0.01)
SELECT feature_view, title, severity, detail, CASE severity
  WHEN 'page' THEN 'on-call' WHEN 'ticket' THEN 'tracker' ELSE 'chat' END AS channel FROM found"""

RULES = (
    *USER_FEATURE_RULES,
    Expectation("home_country", "in_set", {"values": [f"NATION_{i}" for i in range(20)]}),
    Expectation("account_age_days", "unique"),
    Expectation("txn_amount_avg_30d", "between", {"min": 0.0, "max": 50_000.0}),
    Expectation("account_age_days", "of_type", {"type": "float"}),
    Expectation("mcc_risk_score", "not_null"),
)


def dq_report(spark, folder):
    return quality_report(user_rows(spark, folder), RULES, fail_fraction=0.01)


DQ_REPORT = f"""WITH {USER_CTES}, f AS (SELECT count(*) AS n,
  count(*) FILTER (entity_id IS NULL) AS a,
  count(*) FILTER (txn_count_30d < 0 OR txn_count_30d > 100000) AS b,
  count(*) FILTER (chargeback_rate_90d < 0 OR chargeback_rate_90d > 1) AS c,
  count(*) FILTER (home_country IS NULL) AS d,
  count(*) FILTER (home_country IS NULL OR home_country NOT IN (
    SELECT 'NATION_' || i FROM range(20) t(i))) AS e,
  count(*) - count(DISTINCT account_age_days) AS g,
  count(*) FILTER (txn_amount_avg_30d < 0 OR txn_amount_avg_30d > 50000) AS h FROM u),
r AS (SELECT 'entity_id' AS column_name, 'not_null' AS kind, a AS failing, n FROM f
  UNION ALL SELECT 'txn_count_30d', 'between', b, n FROM f
  UNION ALL SELECT 'chargeback_rate_90d', 'between', c, n FROM f
  UNION ALL SELECT 'home_country', 'not_null', d, n FROM f
  UNION ALL SELECT 'txn_amount_avg_30d', 'of_type', 0, n FROM f
  UNION ALL SELECT 'home_country', 'in_set', e, n FROM f
  UNION ALL SELECT 'account_age_days', 'unique', g, n FROM f
  UNION ALL SELECT 'txn_amount_avg_30d', 'between', h, n FROM f
  UNION ALL SELECT 'account_age_days', 'of_type', n, n FROM f
  UNION ALL SELECT 'mcc_risk_score', 'not_null', n, n FROM f)
SELECT column_name, kind, failing, failing / CAST(n AS DOUBLE) AS fraction,
       failing / CAST(n AS DOUBLE) <= 0.01 AS passed FROM r"""


def low_usage(spark, folder):
    """Views nobody read in the 90 days before mid-April."""
    known = [(name,) for name in VIEWS]
    named = spark.createDataFrame(known, "feature_view string")
    reads = read_log(spark, folder)
    late = reads.where("feature_view = 'user_features_v2'").withColumn(
        "event_ts", F.col("event_ts") - F.expr("INTERVAL 20 DAYS")
    )
    log = reads.where("feature_view <> 'user_features_v2'").unionByName(late)
    unused = low_usage_views(named, log, at("2024-04-15"))
    return unused.withColumn("last_read", plain("last_read"))


LOW_USAGE = f"""WITH {READS_SQL}, log AS (SELECT feature_view,
    max(CASE feature_view WHEN 'user_features_v2' THEN event_ts - INTERVAL 20 DAYS
        ELSE event_ts END) AS last_read FROM reads GROUP BY feature_view)
SELECT v.feature_view, last_read FROM (VALUES ('user_features_v2'), ('merchant_features_v1'),
  ('transaction_features_v1'), ('user_merchant_features_v1')) v(feature_view)
LEFT JOIN log ON v.feature_view = log.feature_view
WHERE last_read IS NULL OR last_read < TIMESTAMP '2024-04-15' - INTERVAL 90 DAYS"""

def _stored_views(spark: SparkSession, folder: str) -> list[FeatureTable]:
    """One stored view per event type, its rows in two writes; cheap amounts are missing or no number."""
    root = work_folder(spark, "views")
    rows = events(spark, folder).select(
        F.col("user_id").alias("entity_id"),
        "event_ts",
        F.when(F.col("amount") >= 20, F.col("amount")).when(F.col("amount") >= 10, F.lit(float("nan"))).alias("amount"),
        F.when(F.col("merchant_id").cast("int") < 95, F.col("merchant_id")).alias("merchant_id"),
        F.col("event_ts").alias("created_ts"),
        "event_type",
    )
    tables = []
    for name in ("click", "error", "purchase", "signup", "view"):
        table = FeatureTable(spark, root, name, "amount double, merchant_id string")
        mine = rows.where(F.col("event_type") == name)
        for early in (True, False):
            table.append_versions(mine.where((F.dayofmonth("event_ts") < 20) == F.lit(early)))
        tables.append(table)
    return tables


def stored_freshness_(spark, folder):
    """Freshness of stored views from what their writes noted."""
    return stored_freshness(_stored_views(spark, folder), _slas(spark), at(NOW))


def stored_null_rates_(spark, folder):
    """Missing values of stored views over two weeks, from what their writes noted."""
    return stored_null_rates(_stored_views(spark, folder), date(2024, 1, 10), date(2024, 1, 23))


STORED_NULL_RATES = f"""WITH {EVENT_TXNS}, r AS (
  SELECT event_type AS feature_view, avg(CAST(amount < 20 OR amount IS NULL AS INT)) AS amount,
    avg(CAST(CAST(merchant_id AS INT) >= 95 OR merchant_id IS NULL AS INT)) AS merchant_id
  FROM events_t WHERE event_ts >= TIMESTAMP '2024-01-10' AND event_ts < TIMESTAMP '2024-01-24' GROUP BY event_type)
SELECT feature_view, feature, null_rate, null_rate > 0.05 AS breached
FROM (UNPIVOT r ON amount, merchant_id INTO NAME feature VALUE null_rate)"""


def baseline_stored(spark, folder):
    """The baseline and the current day of a stored view, from their days' folders alone."""
    table = FeatureTable(spark, work_folder(spark, "baseline"), "transactions", "amount double, merchant_id string, txn long")
    rows = events(spark, folder).withColumns(
        {"entity_id": F.col("user_id"), "txn": F.col("transaction_id").cast("long"), "created_ts": F.col("event_ts")}
    )
    table.append_versions(rows)
    old, new = stored_baseline(table, date(2024, 1, 29), days=21)
    both = old.withColumn("sample", F.lit("baseline")).unionByName(new.withColumn("sample", F.lit("current")))
    due = baseline_due(date(2024, 1, 1), date(2024, 1, 29))
    return both.groupBy("sample").agg(
        F.count(F.lit(1)).alias("rows"),
        double_sum("amount").alias("amount_sum"),
        F.count_distinct("merchant_id").alias("merchants"),
        F.lit(due).alias("due"),
    )


QUERIES = {
    "null_rates": null_rates_,
    "psi": psi,
    "ks": ks,
    "drift_report": drift_report_,
    "drift_sliced": drift_sliced,
    "baseline": baseline,
    "baseline_stored": baseline_stored,
    "stored_freshness": stored_freshness_,
    "stored_null_rates": stored_null_rates_,
    "freshness": freshness_,
    "skew": skew,
    "latency_p99": latency_p99_,
    "rows_per_minute": rows_per_minute_,
    "alerts": alerts,
    "dq_report": dq_report,
    "low_usage": low_usage,
}
ORACLES = {
    "null_rates": NULL_RATES,
    "psi": PSI,
    "ks": KS,
    "drift_report": DRIFT_REPORT,
    "drift_sliced": DRIFT_REPORT,
    "baseline": BASELINE,
    "baseline_stored": BASELINE,
    "stored_freshness": FRESHNESS,
    "stored_null_rates": STORED_NULL_RATES,
    "freshness": FRESHNESS,
    "skew": SKEW,
    "latency_p99": LATENCY_P99,
    "rows_per_minute": ROWS_PER_MINUTE,
    "alerts": ALERTS,
    "dq_report": DQ_REPORT,
    "low_usage": LOW_USAGE,
}
