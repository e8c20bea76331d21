"""Embedding near-duplicates by cross-polytope hashing.

Random sign flips and fast Hadamard transforms rotate each vector; the axis it then lies nearest to, with its sign, is a
hash, and several such hashes make a bucket. Each vector also enters the buckets that it misses by little (multiprobe).
Vectors that share a bucket are compared exactly, block by block: large buckets are cut into blocks, and each pair of
blocks is one small task that returns link counts and a spanning forest of its links, never the pairs. A pair met in
several tables counts in the first of them only.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, list_parts, saved
from tidemark.llm.components import components

SEED = 20240611
#: Buckets each vector enters per table; members of a block.
PROBES, BLOCK = 6, 256
#: Share of pairs at the threshold itself that must meet in a bucket, by simulation; the most tables.
RECALL, MAX_TABLES = 0.999, 96


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        rows = rows.reshape(n, -1, 2, half)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / math.sqrt(width)


@lru_cache(64)
def _signs(table: int, part: int, width: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, table, part, width])
    return rng.choice(np.array([-1.0, 1.0], np.float32), (3, width))


def buckets(unit: np.ndarray, table: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers ``(vectors, probes)`` of one table: the nearest axes first, then the cheapest changes of axis."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width), np.float32)
    padded[:, :dim] = unit
    axes, losses = [], []
    alternatives = min(4, 2 * width)
    for part in range(hashes):
        turned = padded
        for signs in _signs(table, part, width):
            turned = hadamard(turned * signs)
        both = np.concatenate([turned, -turned], axis=1)
        best = np.argpartition(-both, alternatives - 1, axis=1)[:, :alternatives]
        value = np.take_along_axis(both, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        axes.append(np.take_along_axis(best, order, 1).astype(np.int64))
        value = np.take_along_axis(value, order, 1)
        losses.append(value[:, :1] - value)
    choices = np.stack(np.meshgrid(*[np.arange(alternatives)] * hashes, indexing="ij"), -1).reshape(-1, hashes)
    # Combinations that change much can't be among the first probes.
    choices = choices[np.prod(choices + 1, axis=1) <= probes]
    loss = sum(losses[k][:, choices[:, k]] ** 2 for k in range(hashes))
    pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    number = np.zeros((n, len(choices)), np.int64)
    for k in range(hashes):
        number = number * (2 * width) + axes[k][:, choices[:, k]]
    return np.take_along_axis(number, pick, 1)


@lru_cache(16)
def plan_tables(dim: int, hashes: int, threshold: float, recall: float = RECALL) -> int:
    """Tables needed for pairs at the threshold to meet with the wanted chance, from 1,000 simulated pairs."""
    rng = np.random.default_rng([SEED, dim, hashes])
    a = rng.standard_normal((1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1000, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = threshold * a + math.sqrt(1 - threshold**2) * b
    met = np.zeros(1000, bool)
    for table in range(MAX_TABLES):
        x, y = buckets(a, table, hashes), buckets(b, table, hashes)
        met |= (x[:, :, None] == y[:, None, :]).any((1, 2))
        if met.mean() >= recall:
            return table + 1
    return MAX_TABLES


def _unit(column: pa.ListArray, dim: int) -> np.ndarray:
    values, _ = list_parts(column.cast(pa.list_(pa.float64())))
    rows = values.view(np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges between small numbers."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def _links(vectors: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(row, links)`` and forest edges ``(a, b)`` of ``vectors(row, copies, vector)`` of one dimension.

    ``links`` counts the copies that the linked vectors stand for.
    """
    total = vectors.count()
    hashes = max(1, round(math.log(max(2, total)) / math.log(4 * dim)))
    tables = plan_tables(dim, hashes, threshold)

    def hashed(parts):
        for batch in parts:
            unit = _unit(batch.column("vector"), dim)
            row = np.asarray(batch.column("row"))
            all_buckets = np.stack([buckets(unit, t, hashes) for t in range(tables)], 1)
            n, _, probes = all_buckets.shape
            table = np.broadcast_to(np.arange(tables)[None, :, None], all_buckets.shape)
            owner = np.broadcast_to(row[:, None, None], all_buckets.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.ravel()) for x in (owner, table.astype(np.int32), all_buckets)], ["row", "table", "bucket"]
            )

    entries = saved(arrow_map(vectors, hashed, "row long, table int, bucket long"), "buckets")
    sizes = entries.groupBy("table", "bucket").agg(F.count("*").alias("of")).where("of > 1")
    # Members are dealt to blocks by hash; each pair of blocks is a group of at most about two blocks.
    blocks = F.ceil(F.col("of") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    member = entries.join(sizes.withColumn("blocks", blocks).drop("of"), ["table", "bucket"]).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = member.withColumn("other", other).select(
        "row", "table", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block"
    )
    key = ["table", "bucket", "lo", "hi"]
    grouped = placed.join(vectors, "row").repartition(*key).sortWithinPartitions(*key, "row")

    def compare(unit, row, table, block, lo, hi):
        """Linked pairs of one pair of blocks: numbers within it, each pair once."""
        gram = unit @ unit.T
        if lo == hi:
            near = np.triu(gram >= threshold, 1)
        else:
            near = (gram >= threshold) & (block == lo)[:, None] & (block == hi)[None, :]
        a, b = np.nonzero(near)
        if table and len(a):
            some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            place_a, place_b = place[: len(a)], place[len(a) :]
            first = np.ones(len(a), bool)
            for t in range(table):
                number = buckets(unit[some], t, hashes)
                for x in range(number.shape[1]):
                    for y in range(number.shape[1]):
                        first &= number[place_a, x] != number[place_b, y]
                if not first.any():
                    break
            a, b = a[first], b[first]
        return a, b

    def pairs(parts):
        held: list[pa.RecordBatch] = []

        def group(rows: pa.Table):
            row = np.asarray(rows.column("row").combine_chunks())
            # A pair may meet in several probes of one table: bucket by bucket, only the smallest bucket counts it.
            unit = _unit(rows.column("vector").combine_chunks(), dim)
            table, bucket, lo, hi = (rows.column(c)[0].as_py() for c in key)
            a, b = compare(unit, row, table, np.asarray(rows.column("block").combine_chunks()), lo, hi)
            if len(a):
                own = buckets(unit, table, hashes)
                common = np.full(len(a), np.iinfo(np.int64).max)
                for x in range(own.shape[1]):
                    hit = (own[a, x][:, None] == own[b]).any(1)
                    common = np.where(hit, np.minimum(common, own[a, x]), common)
                a, b = a[common == bucket], b[common == bucket]
            if not len(a):
                return None
            copies = np.asarray(rows.column("copies").combine_chunks())
            count = np.zeros(len(row), np.int64)
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            some = np.flatnonzero(count)
            edges = _forest(a, b)
            ends = np.array(edges, np.int64).reshape(-1, 2)
            n = len(some) + len(ends)
            out_row = np.concatenate([row[some], row[ends[:, 0]]])
            links = pa.array(np.concatenate([count[some], np.zeros(len(ends), np.int64)]))
            far = np.concatenate([np.full(len(some), -1), row[ends[:, 1]]])
            mask = np.arange(n) < len(some)
            return pa.RecordBatch.from_arrays(
                [pa.array(out_row), links, pa.array(far, pa.int64(), mask=mask)], ["row", "links", "far"]
            )

        def runs(table: pa.Table, last: bool):
            """The complete groups of a sorted table and the rest of it."""
            keys = np.stack([np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in key])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
            edges = [0, *cuts.tolist(), *([table.num_rows] if last else [])]
            out = [r for a, b in zip(edges, edges[1:]) if b - a > 1 and (r := group(table.slice(a, b - a))) is not None]
            return out, table.slice(edges[-1]) if not last else None

        names = None
        for batch in parts:
            names = batch.schema
            held.append(batch)
            if sum(map(len, held)) >= 4 * BLOCK:
                out, rest = runs(pa.Table.from_batches(held), False)
                yield from out
                held = rest.combine_chunks().to_batches() if rest.num_rows else []
        if held and names is not None:
            yield from runs(pa.Table.from_batches(held), True)[0]

    found = saved(arrow_map(grouped, pairs, "row long, links long, far long"), "links")
    counts = found.where("far IS NULL").groupBy("row").agg(F.sum("links").alias("links"))
    return counts, found.where("far IS NOT NULL").select(F.col("row").alias("a"), F.col("far").alias("b"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``: cosine similarity of at least ``threshold``.

    Cosines are taken in double precision. ``n_links`` is the number of other rows linked directly, ``component_id`` the
    smallest id reachable by links, and a row is kept if that is its own. Every pair returned as linked is verified;
    at the threshold itself about one pair in 1,000 may be missed, closer pairs hardly ever.

    Equal vectors are compared once and stand for all their rows, so groups of copies cost nothing. Vectors that are
    null, empty or zero, or have a null or non-finite component, link with nothing, nor do vectors of different
    lengths with one another. Repeated rows link with each other; a null id counts as a row and its component is the
    smallest other id or null. Further columns are ignored; an empty table gives no rows.
    """
    values = F.col(vector_col).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = values.isNotNull() & finite & F.exists(values, lambda x: x != 0)
    # Minus zero equals zero, and vectors that point the same way need not be the same numbers.
    whole = F.when(sound, F.transform(values, lambda x: x + F.lit(0.0)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole.alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    table = saved(rows.select("id", "node", F.size("vector").alias("dim"), "vector"), "vectors")
    classes = saved(
        table.where("node IS NOT NULL")
        .groupBy("node", "dim")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("vector").alias("vector")),
        "classes",
    )
    counts, edges = None, None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        found = _links(classes.where(F.col("dim") == dim).select(F.col("node").alias("row"), "copies", "vector"), dim, threshold)
        counts = found[0] if counts is None else counts.unionByName(found[0])
        edges = found[1] if edges is None else edges.unionByName(found[1])
    if edges is None:
        return table.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    roots = components(edges)
    rooted = (
        classes.select("node", "copies", "first")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(counts.withColumnRenamed("row", "node"), "node", "left")
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(firsts, "root").select("node", "copies", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    out = table.select("id", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
