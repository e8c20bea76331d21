"""Batch features, rolling windows and scalar functions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.keys import entity_id, online_key
from tidemark.functions.ondemand import with_derived
from tidemark.functions.packing import feature_vector
from tidemark.functions.scalars import (
    chargeback_rate,
    ensure_utc,
    event_date,
    is_cross_border,
    log1p_amount,
    parse_duration,
    velocity,
)
from tidemark.operators.batch_features import (
    merchant_features,
    pair_features,
    transaction_features,
    user_features,
    user_peaks,
    with_countries,
)
from tidemark.operators.day_tiles import DayTiles, user_features_from_tiles
from tidemark.operators.rolling import (
    amount_zscores,
    rolling_features,
    seconds_since_previous,
    sliding_window,
)
from tidemark.queries.common import (
    EVENT_TXNS,
    LINE_TXNS,
    ORDER_TXNS,
    at,
    events,
    exact,
    lines,
    plain,
    stored_lines,
    table,
)
from tidemark.session import apply_settings, work_folder
from tidemark.sources.feature_table import instant
from tidemark.sources.streams import decode_transactions
from tidemark.sources.tables import order_transactions, warehouse_until

MONTH = timedelta(days=30)
AS_OF = "2000-06-30"
BACK = "TIMESTAMP '{0}' - INTERVAL {1} DAYS"
MONTH_SQL = f"event_ts BETWEEN {BACK.format(AS_OF, 30)} AND TIMESTAMP '{AS_OF}'"
QUARTER_SQL = f"event_ts BETWEEN {BACK.format(AS_OF, 90)} AND TIMESTAMP '{AS_OF}'"


def orders(spark, folder):
    return order_transactions(apply_settings(spark), folder)


def _stamped(df):
    return df.withColumns(
        {
            "event_ts": plain("event_ts"),
            "created_ts": plain("created_ts"),
            "event_date": F.col("event_date").cast("string"),
        }
    )


STAMP = f"""TIMESTAMP '{AS_OF}' AS event_ts, TIMESTAMP '{AS_OF}' AS created_ts,
       '{AS_OF}' AS event_date"""


def rolling_30d(spark, folder):
    totals = rolling_features(orders(spark, folder), ["user_id"], MONTH)
    return totals.drop("is_chargeback").withColumn("event_ts", plain("event_ts"))


FRAME = (
    "(PARTITION BY user_id ORDER BY event_ts"
    " RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"
)
ROLLING_30D = f"""WITH {ORDER_TXNS}
SELECT transaction_id, user_id, amount, event_ts, count(*) OVER w AS txn_count_30d,
       {exact('amount', 'OVER w')} AS txn_amount_sum_30d,
       {exact('amount', 'OVER w')} / count(amount) OVER w AS txn_amount_avg_30d
FROM orders_t WINDOW w AS {FRAME}"""


def rolling_distinct_(spark, folder):
    counted = rolling_features(
        lines(spark, folder),
        ["user_id"],
        MONTH,
        amount=None,
        distinct={"merchant_id": "distinct_merchants_30d"},
    )
    return counted.select(
        "transaction_id.l_orderkey",
        "transaction_id.l_linenumber",
        "user_id",
        "merchant_id",
        "amount",
        plain("event_ts").alias("event_ts"),
        "distinct_merchants_30d",
    )


ROLLING_DISTINCT = f"""WITH {LINE_TXNS}
SELECT l_orderkey, l_linenumber, user_id, merchant_id, amount, event_ts,
       count(DISTINCT merchant_id) OVER {FRAME} AS distinct_merchants_30d FROM lines_t"""


def _countries(spark, folder):
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return customers.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("n_name").alias("home_country"),
        F.col("n_name").alias("user_country"),
    )


def _merchants(spark, folder):
    suppliers = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return suppliers.select(
        F.col("s_suppkey").cast("string").alias("merchant_id"),
        F.col("n_name").alias("merchant_country"),
    )


USERS_SQL = """users_t AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, n_name AS user_country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MERCHANTS_SQL = """merchants_t AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS merchant_id, n_name AS merchant_country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def user_rows(spark, folder, as_of=AS_OF, txns=None):
    """User features as of a date, refunds standing in for chargebacks; ``txns`` are the order lines, if at hand."""
    txns = lines(spark, folder) if txns is None else txns
    txns = txns.withColumnRenamed("is_refund", "is_chargeback")
    return user_features(txns, at(as_of), countries=_countries(spark, folder))


def user_features_asof(spark, folder):
    return _stamped(user_rows(spark, folder))


def user_features_tiles(spark, folder):
    """The same rows from day tiles and a table of first times, whose updates come in two parts."""
    txns = stored_lines(spark, folder).withColumnRenamed("is_refund", "is_chargeback")
    tiles = DayTiles(spark, work_folder(spark, "tiles"), "user")
    last = at(AS_OF).date()
    days = [last - timedelta(days=i) for i in range(1, 90)]
    for some in (days[45:], days[:45]):
        tiles.update(txns, some, at(AS_OF))
    newer = F.col("event_ts") >= F.lit(AS_OF).cast("timestamp") - timedelta(days=400)
    for some in (newer, ~newer):
        tiles.see(txns.where(some), at(AS_OF))
    return _stamped(user_features_from_tiles(tiles, txns, at(AS_OF), countries=_countries(spark, folder)))


def _if(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


USER_SQL = f"""SELECT l.user_id AS entity_id,
       date_diff('day', CAST(min(event_ts) AS DATE), DATE '{AS_OF}') AS account_age_days,
       count(*) FILTER ({MONTH_SQL}) AS txn_count_30d,
       COALESCE({exact(_if(MONTH_SQL, 'amount'))}, 0) AS txn_amount_sum_30d,
       {exact(_if(MONTH_SQL, 'amount'))} / nullif(count(*) FILTER ({MONTH_SQL}), 0)
         AS txn_amount_avg_30d,
       count(DISTINCT {_if(MONTH_SQL, 'merchant_id')}) AS distinct_merchants_30d,
       COALESCE(count(*) FILTER ({QUARTER_SQL} AND is_refund)
         / CAST(nullif(count(*) FILTER ({QUARTER_SQL}), 0) AS DOUBLE), 0) AS chargeback_rate_90d,
       any_value(user_country) AS home_country
FROM lines_t l LEFT JOIN users_t u ON l.user_id = u.user_id
WHERE event_ts <= TIMESTAMP '{AS_OF}' GROUP BY l.user_id"""
USER_FEATURES_ASOF = f"WITH {LINE_TXNS}, {USERS_SQL}, f AS ({USER_SQL}) SELECT f.*, {STAMP} FROM f"


def user_peak_30d(spark, folder):
    return user_peaks(lines(spark, folder), at(AS_OF))


USER_PEAK_30D = f"""WITH {LINE_TXNS}, r AS (
  SELECT user_id, count(*) OVER w AS n, {exact('amount', 'OVER w')} AS s,
         {exact('amount', 'OVER w')} / count(amount) OVER w AS a,
         count(DISTINCT merchant_id) OVER w AS d
  FROM lines_t WHERE event_ts <= TIMESTAMP '{AS_OF}' WINDOW w AS {FRAME})
SELECT user_id AS entity_id, max(n) AS txn_count_30d, max(s) AS txn_amount_sum_30d,
       max(a) AS txn_amount_avg_30d, max(d) AS distinct_merchants_30d FROM r GROUP BY user_id"""


def user_risk(spark, folder):
    orders(spark, folder).createOrReplaceTempView("warehouse_transactions")
    seen = warehouse_until(spark, "warehouse_transactions", instant(at(AS_OF)))
    txns = seen.withColumn("merchant_id", F.lit(None).cast("string"))
    risk = user_features(txns, at(AS_OF), countries=_countries(spark, folder))
    return risk.select("entity_id", "account_age_days", "chargeback_rate_90d", "home_country")


USER_RISK = f"""WITH {ORDER_TXNS}, {USERS_SQL}
SELECT o.user_id AS entity_id,
       date_diff('day', CAST(min(event_ts) AS DATE), DATE '{AS_OF}') AS account_age_days,
       COALESCE(count(*) FILTER ({QUARTER_SQL} AND is_chargeback)
         / CAST(nullif(count(*) FILTER ({QUARTER_SQL}), 0) AS DOUBLE), 0) AS chargeback_rate_90d,
       any_value(user_country) AS home_country
FROM orders_t o LEFT JOIN users_t u ON o.user_id = u.user_id
WHERE event_ts <= TIMESTAMP '{AS_OF}' GROUP BY o.user_id"""


def pair_rows(spark, folder, as_of=AS_OF, txns=None):
    return pair_features(lines(spark, folder) if txns is None else txns, at(as_of))


def pair_features_(spark, folder):
    return _stamped(pair_rows(spark, folder))


PAIR_SQL = f"""SELECT merchant_id || '|' || user_id AS entity_id, count(*) AS pair_txn_count_90d,
       {exact('amount')} AS pair_amount_sum_90d,
       arg_max(amount, (event_ts, l_orderkey, l_linenumber, l_extendedprice)) AS pair_last_amount,
       CAST(count(*) = 1 AS BIGINT) AS pair_is_first_txn
FROM lines_t WHERE {QUARTER_SQL} GROUP BY user_id, merchant_id"""
PAIR_FEATURES = f"WITH {LINE_TXNS}, f AS ({PAIR_SQL}) SELECT f.*, {STAMP} FROM f"


def merchant_rows(spark, folder, as_of=AS_OF, txns=None):
    return merchant_features(lines(spark, folder) if txns is None else txns, at(as_of))


def merchant_features_(spark, folder):
    return _stamped(merchant_rows(spark, folder))


MERCHANT_SQL = f"""SELECT merchant_id AS entity_id,
       date_diff('day', CAST(min(event_ts) AS DATE), DATE '{AS_OF}') AS merchant_age_days,
       {exact('amount')} / count(amount) AS avg_ticket_size,
       COALESCE(count(*) FILTER ({MONTH_SQL} AND is_refund)
         / CAST(nullif(count(*) FILTER ({MONTH_SQL}), 0) AS DOUBLE), 0) AS refund_rate_30d,
       COALESCE(count(*) FILTER ({QUARTER_SQL} AND is_dispute)
         / CAST(nullif(count(*) FILTER ({QUARTER_SQL}), 0) AS DOUBLE), 0) AS dispute_rate_90d
FROM lines_t WHERE event_ts <= TIMESTAMP '{AS_OF}' GROUP BY merchant_id"""
MERCHANT_FEATURES = f"WITH {LINE_TXNS}, f AS ({MERCHANT_SQL}) SELECT f.*, {STAMP} FROM f"


def _rounded(column):
    return F.round(column, 6).alias(column)


def txn_zscore(spark, folder):
    scored = amount_zscores(orders(spark, folder), ["user_id"], MONTH)
    return scored.select("transaction_id", "user_id", _rounded("amount_zscore_user_30d"))


Z_SQL = """CASE WHEN COALESCE(sd, 0) <= 0 THEN 0 ELSE (amount - mean) / sd END"""
TXN_ZSCORE = f"""WITH {ORDER_TXNS}, w AS (
  SELECT *, {exact('amount', 'OVER w')} / count(amount) OVER w AS mean,
         stddev_samp(amount) OVER w AS sd
  FROM orders_t WINDOW w AS {FRAME})
SELECT transaction_id, user_id, round({Z_SQL}, 6) AS amount_zscore_user_30d FROM w"""


def txn_gap(spark, folder):
    gaps = seconds_since_previous(orders(spark, folder), ["user_id"])
    return gaps.select("transaction_id", "user_id", "seconds_since_prev_txn")


GAP_SQL = """(epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (
         PARTITION BY user_id ORDER BY event_ts, transaction_id))) // 1000000"""
TXN_GAP = f"""WITH {ORDER_TXNS}
SELECT transaction_id, user_id, {GAP_SQL} AS seconds_since_prev_txn FROM orders_t"""


def cross_border(spark, folder):
    users, merchants = _countries(spark, folder), _merchants(spark, folder)
    txns = with_countries(lines(spark, folder), users, merchants)
    flag = is_cross_border(F.col("user_country"), F.col("merchant_country"))
    return txns.select(
        "transaction_id.l_orderkey",
        "transaction_id.l_linenumber",
        "user_country",
        "merchant_country",
        flag.cast("long").alias("is_cross_border"),
    )


CROSS_BORDER = f"""WITH {LINE_TXNS}, {USERS_SQL}, {MERCHANTS_SQL}
SELECT l_orderkey, l_linenumber, user_country, merchant_country,
       CAST(COALESCE(user_country <> merchant_country, FALSE) AS BIGINT) AS is_cross_border
FROM lines_t LEFT JOIN users_t USING (user_id) LEFT JOIN merchants_t USING (merchant_id)"""


def transaction_features_(spark, folder):
    """All four transaction features on the events; merchants are suppliers by number."""
    txns = events(spark, folder).drop("event_type", "is_chargeback")
    users, merchants = _countries(spark, folder), _merchants(spark, folder)
    out = transaction_features(with_countries(txns, users, merchants))
    return out.withColumns(
        {
            "event_ts": plain("event_ts"),
            "amount_zscore_user_30d": F.round("amount_zscore_user_30d", 6),
        }
    )


TRANSACTION_FEATURES = f"""WITH {EVENT_TXNS}, {USERS_SQL}, {MERCHANTS_SQL}, w AS (
  SELECT *, {exact('amount', 'OVER w')} / count(amount) OVER w AS mean,
         stddev_samp(amount) OVER w AS sd, {GAP_SQL} AS seconds_since_prev_txn
  FROM events_t WINDOW w AS {FRAME})
SELECT CAST(transaction_id AS VARCHAR) AS entity_id, event_ts, amount,
       round({Z_SQL}, 6) AS amount_zscore_user_30d, seconds_since_prev_txn,
       CAST(COALESCE(user_country <> merchant_country, FALSE) AS BIGINT) AS is_cross_border
FROM w LEFT JOIN users_t USING (user_id) LEFT JOIN merchants_t USING (merchant_id)"""


def sliding_window_(spark, folder):
    txns = events(spark, folder).select("transaction_id", "user_id", "event_ts", "amount")
    counted = sliding_window(txns, ["user_id"], timedelta(hours=6), value="amount")
    return counted.withColumn("event_ts", plain("event_ts"))


SLIDING_WINDOW = f"""WITH {EVENT_TXNS}
SELECT transaction_id, user_id, event_ts, amount, count(*) OVER w AS window_count,
       {exact('amount', 'OVER w')} AS window_sum,
       count(*) OVER w / (21600 / 60.0::DOUBLE) AS velocity_per_min
FROM events_t WINDOW w AS (PARTITION BY user_id ORDER BY event_ts
  RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)"""


# Amounts far from money: sums must not depend on a column's size.
SCALES = {"tiny": 1e-6, "huge": 1e12}


def _scaled(build):
    """One query over the amounts at every scale."""

    def query(spark, folder):
        parts = [
            build(spark, folder, F.col("amount") * F.lit(factor)).withColumn("scale", F.lit(name))
            for name, factor in SCALES.items()
        ]
        return parts[0].unionByName(parts[1])

    return query


def _scaled_sql(sql: str, source: str, rows: str) -> str:
    """The same in SQL: ``rows``, the expression that makes ``source``, with its amounts replaced."""
    parts = []
    for name, factor in SCALES.items():
        scaled = f"SELECT * REPLACE (amount * {factor!r}::DOUBLE AS amount) FROM {source}_0"
        made = rows.replace(f"{source} AS (", f"{source}_0 AS (", 1) + f", {source} AS ({scaled})"
        parts.append(f"SELECT *, '{name}' AS scale FROM ({sql.replace(rows, made, 1)})")
    return " UNION ALL ".join(parts)


@_scaled
def rolling_30d_scaled(spark, folder, amount):
    totals = rolling_features(orders(spark, folder).withColumn("amount", amount), ["user_id"], MONTH)
    return totals.drop("is_chargeback").withColumn("event_ts", plain("event_ts"))


@_scaled
def sliding_window_scaled(spark, folder, amount):
    txns = events(spark, folder).select("transaction_id", "user_id", "event_ts", amount.alias("amount"))
    counted = sliding_window(txns, ["user_id"], timedelta(hours=6), value="amount")
    return counted.withColumn("event_ts", plain("event_ts"))


@_scaled
def txn_zscore_scaled(spark, folder, amount):
    scored = amount_zscores(orders(spark, folder).withColumn("amount", amount), ["user_id"], MONTH)
    return scored.select("transaction_id", "user_id", _rounded("amount_zscore_user_30d"))


@_scaled
def user_features_scaled(spark, folder, amount):
    txns = lines(spark, folder).withColumnRenamed("is_refund", "is_chargeback")
    found = user_features(
        txns.withColumn("amount", amount), at(AS_OF), countries=_countries(spark, folder)
    )
    return found.select("entity_id", "txn_count_30d", "txn_amount_sum_30d", "txn_amount_avg_30d")


USER_SUMS = f"""WITH {LINE_TXNS}, {USERS_SQL}, f AS ({USER_SQL})
SELECT entity_id, txn_count_30d, txn_amount_sum_30d, txn_amount_avg_30d FROM f"""


def txn_gap_ties(spark, folder):
    """Each event twice on one instant under one id, with light keys and with all keys split."""
    txns = events(spark, folder).select("transaction_id", "user_id", "event_ts", "amount")
    # Whole hours make crowded instants.
    txns = txns.withColumn("event_ts", F.date_trunc("hour", "event_ts"))
    twice = txns.unionByName(txns)
    parts = [
        seconds_since_previous(twice, ["user_id"], rows_per_slice=rows)
        .groupBy("user_id", "seconds_since_prev_txn")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("slices", F.lit(name))
        for name, rows in (("none", None), ("small", 8))
    ]
    return parts[0].unionByName(parts[1])


TXN_GAP_TIES = f"""WITH {EVENT_TXNS}, h AS (
  SELECT user_id, transaction_id, date_trunc('hour', event_ts) AS event_ts FROM events_t),
twice AS (SELECT * FROM h UNION ALL SELECT * FROM h),
g AS (SELECT user_id, {GAP_SQL} AS seconds_since_prev_txn FROM twice)
SELECT user_id, seconds_since_prev_txn, count(*) AS rows, slices
FROM g, (VALUES ('none'), ('small')) v(slices) GROUP BY ALL"""


def scalar_transforms(spark, folder):
    """Scalar functions over every line: zero denominators and negative amounts included."""
    rows = table(spark, folder, "lineitem")
    count, quantity = F.col("l_linenumber") - 1, F.col("l_quantity")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        chargeback_rate(quantity, count).alias("chargeback_rate"),
        F.round(log1p_amount(quantity - 25.0), 9).alias("log1p_amount"),
        velocity(quantity, count * 60).alias("velocity"),
        F.unix_micros(ensure_utc(F.col("l_shipdate"))).alias("ship_micros"),
        event_date(F.col("l_shipdate")).cast("string").alias("event_date"),
    )


SCALAR_TRANSFORMS = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber - 1 > 0 THEN l_quantity / (l_linenumber - 1) ELSE 0 END AS chargeback_rate,
  round(ln(1 + greatest(l_quantity - 25.0, 0.0)), 9) AS log1p_amount,
  CASE WHEN l_linenumber - 1 <= 0 THEN 0
       ELSE l_quantity / ((l_linenumber - 1) * 60 / 60.0::DOUBLE) END AS velocity,
  epoch_us(l_shipdate) AS ship_micros, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS event_date
FROM lineitem"""


def ondemand_ratios(spark, folder):
    """Request-time ratios of every later order against its user's stored features."""
    stored = user_rows(spark, folder).select(
        F.col("entity_id").alias("user_id"), "txn_amount_avg_30d", "txn_amount_sum_30d"
    )
    requests = orders(spark, folder).where(F.col("event_ts") > F.lit(AS_OF).cast("timestamp"))
    merged = requests.select("transaction_id", "user_id", "amount").join(stored, "user_id", "left")
    ratios = with_derived(merged, ["amount_to_avg_ratio", "transaction_ratios"])
    return ratios.select("transaction_id", "amount_to_avg_ratio", "amount_to_sum_ratio")


ONDEMAND_RATIOS = f"""WITH {ORDER_TXNS}, {LINE_TXNS}, {USERS_SQL}, f AS ({USER_SQL})
SELECT transaction_id, COALESCE(amount / nullif(txn_amount_avg_30d, 0), 0) AS amount_to_avg_ratio,
       COALESCE(amount / nullif(txn_amount_sum_30d, 0), 0) AS amount_to_sum_ratio
FROM orders_t o LEFT JOIN f ON o.user_id = f.entity_id WHERE event_ts > TIMESTAMP '{AS_OF}'"""


def composite_keys(spark, folder):
    """Ids of keys that themselves contain the separator and the escape character."""
    left = F.concat_ws("|", "event_type", "merchant_id")
    right = F.concat(F.col("merchant_id"), F.lit("\\"), F.col("user_id"))
    keys = {"b_key": right, "a_key": left}
    return events(spark, folder).select(
        "transaction_id",
        entity_id(keys).alias("entity_id"),
        online_key("user_merchant_features_v1", keys).alias("online_key"),
    )


COMPOSITE_KEYS = f"""WITH {EVENT_TXNS}, k AS (
  SELECT transaction_id, replace(replace(event_type || '|' || merchant_id, '\\', '\\\\'), '|', '\\|')
    || '|' || replace(replace(merchant_id || '\\' || user_id, '\\', '\\\\'), '|', '\\|') AS entity_id
  FROM events_t)
SELECT transaction_id, entity_id, 'user_merchant_features_v1:' || entity_id AS online_key FROM k"""


def parse_durations(spark, folder):
    """Duration texts made of each event's property and a unit by its type."""
    unit = (
        F.when(F.col("event_type") == "click", "s")
        .when(F.col("event_type") == "error", "m")
        .when(F.col("event_type") == "purchase", "h")
        .when(F.col("event_type") == "signup", "d")
        .otherwise("w")
    )
    spec = F.concat(F.lit(" "), F.col("merchant_id"), unit)
    return events(spark, folder).select(
        "transaction_id", spec.alias("spec"), parse_duration(spec).alias("seconds")
    )


PARSE_DURATIONS = f"""WITH {EVENT_TXNS}, u AS (
  SELECT * FROM (VALUES ('click', 's', 1), ('error', 'm', 60), ('purchase', 'h', 3600),
    ('signup', 'd', 86400), ('view', 'w', 604800)) v(event_type, unit, length))
SELECT transaction_id, ' ' || merchant_id || unit AS spec,
       CAST(merchant_id AS BIGINT) * length AS seconds
FROM events_t JOIN u USING (event_type)"""


def json_decode(spark, folder):
    """Each event as the JSON message a producer would send, decoded again."""
    message = F.to_json(
        F.struct(
            F.col("transaction_id").cast("string").alias("transaction_id"),
            "user_id",
            "merchant_id",
            "amount",
            "event_ts",
        )
    )
    decoded = decode_transactions(events(spark, folder).select(message.alias("value")))
    # The JSON writer keeps milliseconds.
    return decoded.withColumn("event_ts", plain(F.date_trunc("millisecond", "event_ts")))


JSON_DECODE = f"""WITH {EVENT_TXNS}
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, user_id, merchant_id, amount,
       date_trunc('millisecond', event_ts) AS event_ts FROM events_t"""


def feature_vector_(spark, folder):
    """User features packed into typed maps, listed entry by entry."""
    features = ["account_age_days", "txn_amount_avg_30d", "chargeback_rate_90d", "home_country"]
    rows = user_rows(spark, folder)
    packed = rows.select("entity_id", *[c.alias(n) for n, c in feature_vector(rows, features).items()])
    numeric = packed.select("entity_id", F.explode("numeric").alias("feature", "number"))
    text = packed.select("entity_id", F.explode("text").alias("feature", "string"))
    return numeric.withColumn("string", F.lit(None).cast("string")).unionByName(
        text.withColumn("number", F.lit(None).cast("double"))
    )


FEATURE_VECTOR = f"""WITH {LINE_TXNS}, {USERS_SQL}, f AS ({USER_SQL})
SELECT entity_id, 'account_age_days' AS feature, CAST(account_age_days AS DOUBLE) AS number,
       CAST(NULL AS VARCHAR) AS string FROM f
UNION ALL SELECT entity_id, 'txn_amount_avg_30d', txn_amount_avg_30d, NULL FROM f
  WHERE txn_amount_avg_30d IS NOT NULL
UNION ALL SELECT entity_id, 'chargeback_rate_90d', chargeback_rate_90d, NULL FROM f
UNION ALL SELECT entity_id, 'home_country', NULL, home_country FROM f WHERE home_country IS NOT NULL"""

# Every so many transactions with an amount that is no plain number, or too large for a decimal.
ODD_AMOUNTS = {97: "NaN", 89: "Infinity", 83: "-Infinity", 79: "1e39"}


def _odd(column):
    odd = F.col(column)
    for step, value in ODD_AMOUNTS.items():
        odd = F.when(F.col("transaction_id") % step == 0, F.lit(float(value))).otherwise(odd)
    return odd


def _odd_sql(source: str, rows: str) -> str:
    """The expression that makes ``source``, with the same amounts."""
    cases = " ".join(
        f"WHEN transaction_id % {step} = 0 THEN '{value}'::DOUBLE"
        for step, value in reversed(ODD_AMOUNTS.items())
    )
    odd = f"SELECT * REPLACE (CASE {cases} ELSE amount END AS amount) FROM {source}_0"
    return rows.replace(f"{source} AS (", f"{source}_0 AS (", 1) + f", {source} AS ({odd})"


def _kinds(rows, *names):
    """Sums told apart by kind, and the finite ones."""
    kinds = {}
    for name in names:
        x = F.col(name)
        kinds[f"{name}_kind"] = (
            F.when(F.isnan(x), "nan").when(x == float("inf"), "up").when(x == float("-inf"), "down").otherwise("finite")
        )
        kinds[name] = F.when(F.abs(x) < float("inf"), x)
    return rows.withColumns(kinds)


def _kinds_sql(sql: str, *names: str) -> str:
    kinds = ", ".join(
        f"CASE WHEN isnan({n}) THEN 'nan' WHEN {n} = 'inf'::DOUBLE THEN 'up'"
        f" WHEN {n} = '-inf'::DOUBLE THEN 'down' ELSE 'finite' END AS {n}_kind"
        for n in names
    )
    kept = ", ".join(f"CASE WHEN isfinite({n}) THEN {n} END AS {n}" for n in names)
    return f"SELECT * REPLACE ({kept}), {kinds} FROM ({sql})"


def rolling_30d_special(spark, folder):
    """Windows over NaN, infinities and amounts beyond decimals, which leave with their rows."""
    totals = rolling_features(orders(spark, folder).withColumn("amount", _odd("amount")), ["user_id"], MONTH)
    kept = totals.select("transaction_id", "txn_count_30d", "txn_amount_sum_30d")
    return _kinds(kept, "txn_amount_sum_30d")


ROLLING_30D_SPECIAL = _kinds_sql(
    f"""WITH {_odd_sql("orders_t", ORDER_TXNS)}
SELECT transaction_id, count(*) OVER w AS txn_count_30d, sum(amount) OVER w AS txn_amount_sum_30d
FROM orders_t WINDOW w AS {FRAME}""",
    "txn_amount_sum_30d",
)


def merchant_sums_special(spark, folder):
    """Average ticket of merchants over the same amounts, where nothing is taken out again."""
    txns = lines(spark, folder).withColumn("transaction_id", F.col("transaction_id.l_orderkey"))
    found = merchant_features(txns.withColumn("amount", _odd("amount")), at(AS_OF))
    return _kinds(found.select("entity_id", "avg_ticket_size"), "avg_ticket_size")


MERCHANT_SUMS_SPECIAL = _kinds_sql(
    f"""WITH {_odd_sql("lines_t", LINE_TXNS.replace("SELECT l_orderkey,", "SELECT l_orderkey AS transaction_id, l_orderkey,"))}
SELECT merchant_id AS entity_id, sum(amount) / count(amount) AS avg_ticket_size
FROM lines_t WHERE event_ts <= TIMESTAMP '{AS_OF}' GROUP BY merchant_id""",
    "avg_ticket_size",
)


def spread_far_from_zero(spark, folder):
    """Deviations of amounts that all lie beyond 1e9, from exact sums of squares."""
    far = orders(spark, folder).withColumn("amount", F.col("amount") + F.lit(1e9))
    totals = rolling_features(far, ["user_id"], MONTH, spread=True)
    return totals.select("transaction_id", F.round("txn_amount_std_30d", 1).alias("txn_amount_std_30d"))


# What is left after taking the shift off again is exact, so plain arithmetic finds the same deviation.
SPREAD_FAR_FROM_ZERO = f"""WITH {ORDER_TXNS}, near AS (
  SELECT * REPLACE ((amount + 1e9) - 1e9 AS amount) FROM orders_t)
SELECT transaction_id, round(stddev_samp(amount) OVER w, 1) AS txn_amount_std_30d
FROM near WINDOW w AS {FRAME}"""


QUERIES = {
    "rolling_30d_scaled": rolling_30d_scaled,
    "sliding_window_scaled": sliding_window_scaled,
    "txn_zscore_scaled": txn_zscore_scaled,
    "user_features_scaled": user_features_scaled,
    "rolling_30d_special": rolling_30d_special,
    "merchant_sums_special": merchant_sums_special,
    "spread_far_from_zero": spread_far_from_zero,
    "txn_gap_ties": txn_gap_ties,
    "rolling_30d": rolling_30d,
    "rolling_distinct": rolling_distinct_,
    "user_features_asof": user_features_asof,
    "user_features_tiles": user_features_tiles,
    "user_peak_30d": user_peak_30d,
    "user_risk": user_risk,
    "pair_features": pair_features_,
    "merchant_features": merchant_features_,
    "txn_zscore": txn_zscore,
    "txn_gap": txn_gap,
    "cross_border": cross_border,
    "transaction_features": transaction_features_,
    "sliding_window": sliding_window_,
    "scalar_transforms": scalar_transforms,
    "ondemand_ratios": ondemand_ratios,
    "composite_keys": composite_keys,
    "parse_durations": parse_durations,
    "json_decode": json_decode,
    "feature_vector": feature_vector_,
}
ORACLES = {
    "rolling_30d_scaled": _scaled_sql(ROLLING_30D, "orders_t", ORDER_TXNS),
    "sliding_window_scaled": _scaled_sql(SLIDING_WINDOW, "events_t", EVENT_TXNS),
    "txn_zscore_scaled": _scaled_sql(TXN_ZSCORE, "orders_t", ORDER_TXNS),
    "user_features_scaled": _scaled_sql(USER_SUMS, "lines_t", LINE_TXNS),
    "rolling_30d_special": ROLLING_30D_SPECIAL,
    "merchant_sums_special": MERCHANT_SUMS_SPECIAL,
    "spread_far_from_zero": SPREAD_FAR_FROM_ZERO,
    "txn_gap_ties": TXN_GAP_TIES,
    "rolling_30d": ROLLING_30D,
    "rolling_distinct": ROLLING_DISTINCT,
    "user_features_asof": USER_FEATURES_ASOF,
    "user_features_tiles": USER_FEATURES_ASOF,
    "user_peak_30d": USER_PEAK_30D,
    "user_risk": USER_RISK,
    "pair_features": PAIR_FEATURES,
    "merchant_features": MERCHANT_FEATURES,
    "txn_zscore": TXN_ZSCORE,
    "txn_gap": TXN_GAP,
    "cross_border": CROSS_BORDER,
    "transaction_features": TRANSACTION_FEATURES,
    "sliding_window": SLIDING_WINDOW,
    "scalar_transforms": SCALAR_TRANSFORMS,
    "ondemand_ratios": ONDEMAND_RATIOS,
    "composite_keys": COMPOSITE_KEYS,
    "parse_durations": PARSE_DURATIONS,
    "json_decode": JSON_DECODE,
    "feature_vector": FEATURE_VECTOR,
}
