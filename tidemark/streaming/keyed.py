"""Per-event trailing windows on a stream, with the recent events of each user as keyed state.

Users share a fixed number of groups by a hash, since a call per group costs far more than the few events of a user. A
micro-batch reads and writes the state of the groups it has events of, and no other; within one, users are told apart by name
and summed one by one. What can't be reached any more is dropped when its group is called, at the latest by a timer in event
time after the group's last event. A user with too many events for one group is split: each
of its events is stored under one of ``n`` sub-keys by a hash, asks all of them, and the partial windows are added up. What
``sliding_stream`` does with a table beside the checkpoint this does in the state store, so its work follows the batch's
groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import velocity
from tidemark.operators.asof import micros
from tidemark.streaming.velocity import start

_STATE = "name array<string>, n array<long>, at array<long>, value array<double>"
_PARTIAL = "_id string, _n long, _sum double"
#: Split users at most: the table of them is small whatever the stream is.
MAX_SPLIT = 10_000
#: Groups that users share.
GROUPS = 1024


def window_sums(at: np.ndarray, value: np.ndarray, ask: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the values (sorted by ``at``) within ``[t - width, t]`` of each ``t`` in ``ask``.

    NaN and infinities count only in windows that hold them; null values (masked as NaN by the caller) are 0.
    """
    low, high = np.searchsorted(at, ask - width, "left"), np.searchsorted(at, ask, "right")
    finite = np.isfinite(value)

    def between(x: np.ndarray) -> np.ndarray:
        total = np.append(x.dtype.type(0), np.cumsum(x))
        return total[high] - total[low]

    # Whole parts and fractions apart, in 80 bits: taking out what came before leaves no visible error.
    plain = np.where(finite, value, 0.0).astype(np.longdouble)
    whole = np.trunc(plain)
    out = (between(whole) + between(plain - whole)).astype(float)
    nan, up, down = (between(x.astype(np.int64)) > 0 for x in (np.isnan(value), value == np.inf, value == -np.inf))
    out = np.where(up, np.inf, np.where(down, -np.inf, out))
    return high - low, np.where(nan | up & down, np.nan, out)


def _advance(width: int):
    """The state function of one group: its users' stored events, and the events that ask them."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        names, n, at, value = state.get if state.exists else ([], [], [], [])
        user = np.repeat(np.array(names, object), np.array(n, np.int64))
        at, value = np.array(at, np.int64), np.array(value, float)
        keep = at >= mark - width
        user, at, value = user[keep], at[keep], value[keep]
        if state.hasTimedOut:
            # Nothing new: what is left can be reached for a while yet.
            _store(state, user, at, value, mark, width)
            return
        rows = pd.concat(list(frames), ignore_index=True)
        rows = rows[rows["_at"] >= mark]
        mine, asking = rows["_mine"].to_numpy(bool), rows["_user"].to_numpy(object)
        user = np.concatenate([user, asking[mine]])
        at = np.concatenate([at, rows["_at"].to_numpy(np.int64)[mine]])
        value = np.concatenate([value, rows["_value"].to_numpy(float)[mine]])
        code, known = pd.factorize(np.concatenate([user, asking]))
        code, asks = code[: len(user)], code[len(user) :]
        order = np.lexsort((at, code))
        user, at, value, code = user[order], at[order], value[order], code[order]
        if len(rows):
            yield _answers(rows, asks, code, at, value, len(known), width)
        _store(state, user, at, value, mark, width)

    return step


def _answers(rows: pd.DataFrame, asks: np.ndarray, code: np.ndarray, at: np.ndarray, value: np.ndarray, users: int, width: int):
    """The partial windows of all rows. Each user is summed apart, so no other's values can touch the sums."""
    order = np.argsort(asks, kind="stable")
    ask = rows["_at"].to_numpy(np.int64)[order]
    of_ask = np.searchsorted(asks[order], np.arange(users + 1)).tolist()
    stored = np.searchsorted(code, np.arange(users + 1)).tolist()
    n, total = np.zeros(len(ask), np.int64), np.zeros(len(ask))
    for a, b, c, d in zip(of_ask, of_ask[1:], stored, stored[1:]):
        if b > a:
            n[a:b], total[a:b] = window_sums(at[c:d], value[c:d], ask[a:b], width)
    return pd.DataFrame({"_id": rows["_id"].to_numpy()[order], "_n": n, "_sum": total})


def _store(state: GroupState, user: np.ndarray, at: np.ndarray, value: np.ndarray, mark: int, width: int) -> None:
    """Keep the events, each user's together."""
    if not len(at):
        if state.exists:
            state.remove()
        return
    first = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
    n = np.diff(np.append(first, len(user)))
    state.update((user[first].tolist(), n.tolist(), at.tolist(), value.tolist()))
    # After this no event that is still accepted can reach the newest one.
    state.setTimeoutTimestamp(max(int(at.max() + width) // 1000 + 1, mark // 1000 + 1))


def keyed_sliding_stream(
    stream: DataFrame,
    keys: Sequence[str],
    width: timedelta,
    folder: str,
    checkpoint: str,
    *,
    event_id: str,
    value: str = "amount",
    event_ts: str = "event_ts",
    delay: timedelta = timedelta(seconds=10),
    split: Mapping[tuple[str, ...], int] | None = None,
    groups: int = GROUPS,
    every: str | None = None,
) -> StreamingQuery:
    """Append ``event_id, <keys>, event_ts, window_count, window_sum, velocity_per_min`` per event to ``folder``.

    Events later than ``delay`` behind the newest of earlier batches are left out, as are those without a time or a key.
    ``event_id`` tells events apart. ``split`` gives hot keys' numbers of sub-keys (at most ``MAX_SPLIT`` keys), ``groups``
    how many groups share the keys' state; both may change between runs only with a new checkpoint. A batch that is run again overwrites what it wrote.
    """
    keys, split = list(keys), dict(split or {})
    if len(split) > MAX_SPLIT:
        raise ValueError(f"at most {MAX_SPLIT} keys can be split")
    spark, span = stream.sparkSession, micros(width)
    known = F.col(event_ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    events = stream.where(known).withWatermark(event_ts, f"{delay // timedelta(milliseconds=1)} milliseconds").select(
        event_ts,
        F.unix_micros(event_ts).alias("_at"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"),
        F.to_json(
            F.struct(
                F.col(event_id).alias("id"),
                *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                F.unix_micros(event_ts).alias("at"),
            )
        ).alias("_id"),
        F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("_key"),
    )
    number = F.lit(1)
    if split:
        hot = [(list(map(str, k)), n) for k, n in split.items()]
        table = spark.createDataFrame(hot, "k array<string>, _parts int").select(F.to_json("k").alias("_key"), "_parts")
        events = events.join(F.broadcast(table), "_key", "left")
        number = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("_id"), number)
    asks = events.withColumn("_part", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("_mine", F.col("_part") == own)
    user = F.concat_ws("|", F.col("_part").cast("string"), "_key")
    asks = asks.select(
        event_ts, "_at", "_value", "_id", "_mine", user.alias("_user"), F.pmod(F.xxhash64(user), F.lit(groups)).alias("_group")
    )
    partial = asks.groupBy("_group").applyInPandasWithState(
        _advance(span), _PARTIAL, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    schema = ", ".join(
        [f"id {stream.schema[event_id].dataType.simpleString()}"]
        + [f"k{i} {stream.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
        + ["at long"]
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = batch.groupBy("_id").agg(F.sum("_n").alias("window_count"), F.sum("_sum").alias("window_sum"))
        named = whole.withColumn("_e", F.from_json("_id", schema))
        named.select(
            F.col("_e.id").alias(event_id),
            *[F.col(f"_e.k{i}").alias(k) for i, k in enumerate(keys)],
            F.timestamp_micros("_e.at").alias(event_ts),
            "window_count",
            "window_sum",
            velocity(F.col("window_count"), F.lit(width.total_seconds())).alias("velocity_per_min"),
        ).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return start(partial.writeStream.outputMode("append").foreachBatch(write), checkpoint, every)
