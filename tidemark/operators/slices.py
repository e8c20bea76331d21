"""Splitting heavy keys along their order column, so that no key is one task's work.

Ordered work per key (as-of lookups, running totals, previous row) normally hashes on the key, and
a key that holds a third of the table then lands in one task. ``plan_slices`` counts rows per key
(partial aggregation, key columns only) and, for the keys above ``rows_per_slice``, picks cut points
from a mergeable quantile sketch. Rows of a heavy key are later grouped by ``(key, slice)``.

Bounds: a key is heavy only above ``target`` rows and gets ``ceil(rows / target)`` cuts, with
``target >= total / MAX_SLICES``. So there are at most MAX_SLICES heavy keys and 2 * MAX_SLICES cut
values however large the table is, which is what makes collecting and broadcasting them safe.
The cut table is collected once because the sketch depends on merge order: every use of it, and
every retried task, must see the same cuts. Cuts only steer placement, never results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_SLICE = 2_000_000
MAX_SLICES = 50_000
MAX_CUTS_PER_KEY = 16_384


@dataclass(frozen=True)
class Slices:
    """Cut points of the heavy keys; ``table`` is None when no key is heavy.

    ``crowded`` says that several cuts of some key fell on one instant. ``largest`` is the number of rows of the largest key,
    if it was counted.
    """

    keys: tuple[str, ...]
    table: DataFrame | None = None
    longest: int = 0
    crowded: bool = False
    largest: int | None = None

    @property
    def any_heavy(self) -> bool:
        return self.table is not None

    def tag(self, df: DataFrame, at: str, *, heavy_only: bool = False) -> DataFrame:
        """Add ``_below``/``_upto``: how many cuts lie below / at or below the row.

        Both are null for light keys; with ``heavy_only`` their rows are left out.
        """
        how = "inner" if heavy_only else "left"
        upto = F.when(F.col("_cuts").isNotNull(), self._count_cuts(F.col(at), inclusive=True))
        # Only a row exactly on a cut needs the second search.
        on_cut = F.get(F.col("_cuts"), F.col("_upto") - 1) == F.col(at)
        below = F.when(on_cut, self._count_cuts(F.col(at), inclusive=False)).otherwise(F.col("_upto"))
        return (
            df.join(F.broadcast(self.table), list(self.keys), how)
            .withColumn("_upto", upto)
            .withColumn("_below", below)
            .drop("_cuts")
        )

    def grid(self) -> DataFrame:
        """One row per heavy key and cut: keys, ``_slice`` (1-based) and ``_cut``."""
        return self.table.select(
            *self.keys, F.posexplode("_cuts").alias("_pos", "_cut")
        ).select(*self.keys, (F.col("_pos") + 1).alias("_slice"), "_cut")

    def _count_cuts(self, at: Column, *, inclusive: bool) -> Column:
        # Binary search: add falling powers of two while the cut at that position is still passed.
        top = 2 ** max(0, self.longest.bit_length() - 1)
        jumps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])

        def advance(pos: Column, jump: Column) -> Column:
            cut = F.get(F.col("_cuts"), pos + jump - 1)
            passed = (cut <= at) if inclusive else (cut < at)
            return F.when(F.coalesce(passed, F.lit(False)), pos + jump).otherwise(pos)

        return F.aggregate(jumps, F.lit(0), advance)


def plan_slices(
    rows: DataFrame, keys: Sequence[str], at: str, rows_per_slice: int | None = None
) -> Slices:
    """Find the keys of ``rows`` that need splitting along ``at``, and where to cut them."""
    keys = tuple(keys)
    rows_per_slice = rows_per_slice or ROWS_PER_SLICE
    present = rows.select(*keys, at).dropna()
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    if not total or largest <= rows_per_slice:
        return Slices(keys, largest=largest or 0)

    target = max(rows_per_slice, math.ceil(total / MAX_SLICES))
    points = max(1, min(MAX_CUTS_PER_KEY, math.ceil(largest / target)))
    heavy = sizes.where(F.col("_rows") > target)
    wanted = F.least(F.ceil(F.col("_rows") / F.lit(target)), F.lit(points)).cast("int")
    spread = F.expr(
        f"transform(sequence(1, _wanted), i -> element_at(_all,"
        f" cast(greatest(1, floor(i * {points + 1} / (_wanted + 1))) as int)))"
    )
    shares = ", ".join(f"{i / (points + 1)!r}D" for i in range(1, points + 1))
    found = (
        present.join(F.broadcast(heavy), list(keys))
        .groupBy(*keys)
        .agg(
            F.expr(f"percentile_approx({at}, array({shares}), {max(10_000, 4 * points)}) AS _all"),
            F.max(wanted).alias("_wanted"),
        )
        .select(*keys, spread.alias("_cuts"))
    )
    cuts = found.collect()
    if not cuts:
        return Slices(keys)
    schema = T.StructType([found.schema[name] for name in (*keys, "_cuts")])
    table = rows.sparkSession.createDataFrame(cuts, schema)
    longest = max(len(row["_cuts"]) for row in cuts)
    crowded = any(len(set(row["_cuts"])) < len(row["_cuts"]) for row in cuts)
    return Slices(keys, table, longest, crowded)
