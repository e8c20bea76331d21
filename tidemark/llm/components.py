"""Connected components of a large edge table by alternating stars; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, saved

#: Edges that one task walks, at most; the rounds of more go over all partitions.
FEW = 20_000


def _print(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: rows and a sum of hashes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _walked(parts):
    """``(node, root)`` of a few edges ``(a, b)``, by joined sets."""
    root: dict[int, int] = {}

    def find(x):
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for batch in parts:
        for a, b in zip(*(batch.column(i).to_pylist() for i in range(2))):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = np.array([(x, y) for x in list(root) if (y := find(x)) != x], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(2)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` but the roots: root is the smallest node it reaches.

    Repeated edges, loops and edges with a null end are allowed and add nothing. Each round is written to the shared
    folder, so a lost executor costs one round. Rounds grow with the logarithm of the longest chain. Counted first: at most
    ``FEW`` edges are walked by one task.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _print(now)
    if seen[0] <= FEW:
        return saved(arrow_map(now.coalesce(1), _walked, "node long, root long", FEW), "walked")
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, seen = seen, _print(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
