"""Mixing sources to target weights by temperature.

The sources' token shares are raised to an exponent and normalised. The exponent is found by bisection: the flattest mix
whose most repeated source stays within a repetition limit, or the mix of a wanted entropy. Weights then become rows by
budgeted block permutations: each source's documents are dealt into blocks by hash, an epoch is all blocks in an order
drawn for it, and the source takes whole epochs, whole blocks and at last single documents until its budget is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small

#: Tokens of a block, about: what is ordered document by document at the end of a budget.
BLOCK_TOKENS = 1 << 20


def words(text: Column) -> Column:
    """Tokens of a text for weighing sources: runs of anything but ASCII white space; null is none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(tokens: list[float], exponent: float) -> list[float]:
    """Normalised token shares raised to an exponent; sources without tokens stay without."""
    total = sum(tokens)
    raised = [(t / total) ** exponent if t > 0 else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _bisect(good, steps: int = 60) -> float:
    """The smallest exponent in 0..1 that is good, if all larger ones are as well."""
    if good(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def solve_exponent(
    tokens: list[float], max_repeat: float | None = None, target_entropy: float | None = None
) -> float:
    """The exponent for a repetition limit or a target entropy (in nats); 1 keeps the shares, 0 makes them equal.

    Repetition counts passes over a source for one pass over the source that is passed over least. A target beyond
    what exponents in 0..1 reach gives the nearer end.
    """
    tokens = [t for t in tokens if t > 0]
    if (max_repeat is None) == (target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    if len(tokens) < 2:
        return 1.0
    if target_entropy is not None:
        return _bisect(lambda a: entropy(shares(tokens, a)) <= target_entropy)

    def passes(exponent):
        each = [w / t for w, t in zip(shares(tokens, exponent), tokens)]
        return max(each) / min(each)

    return _bisect(lambda a: passes(a) <= max_repeat)


def source_budgets(
    totals: dict[str, int], max_repeat: float | None = None, target_entropy: float | None = None, budget: int | None = None
) -> dict[str, tuple[float, int]]:
    """Weight and token budget per source.

    Without ``budget`` the mix is as large as it takes for every source to be passed over once at least, so that no
    document is lost. Sources without tokens get a budget of 0.
    """
    names = sorted(totals)
    tokens = [totals[x] for x in names]
    if not any(t > 0 for t in tokens):
        return {x: (0.0, 0) for x in names}
    weights = shares(tokens, solve_exponent(tokens, max_repeat, target_entropy))
    if budget is None:
        size = max(t / w for t, w in zip(tokens, weights) if t > 0)
        return {x: (w, max(t, round(w * size))) for x, t, w in zip(names, tokens, weights)}
    return {x: (w, round(w * budget)) for x, w in zip(names, weights)}


def mix(
    docs: DataFrame,
    max_repeat: float | None = 1.5,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with ``n_tokens``, ``weight``, ``epoch`` (from 0), ``block``
    and ``place``.

    Each epoch of a source is a permutation of its blocks: ``place`` is drawn for a block and epoch, and the epoch runs
    through the blocks by ``place`` (ties by ``block``); documents of a block are in the order of a hash of their own.

    Every row comes in all whole epochs of its source's budget, and in the last, partial one if its place in that
    epoch's order lies within what is left of the budget (the document that reaches it is still taken). Rows without
    tokens come once. Null sources are one source; null texts have no tokens. Repeated rows are rows of their own and
    are taken together. Columns of ``docs`` named like the new ones, in either case, are replaced; all
    others come back as they are. An empty table gives no rows.

    What the driver gets is one total per source; orders are taken per block, and inside the one block per source that
    a budget ends in.
    """
    added = ("n_tokens", "weight", "epoch", "block", "place")
    # Column names are told apart without regard to case; names used on the way are such that docs has none like them.
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    names, p = docs.columns, "_mix_"
    while any(c.lower().startswith(p) for c in names):
        p = f"_{p}"
    group, key, block, count, epochs, rest, blocks, before, at, whole_, picked_, t = (
        p + x for x in ("source", "key", "block", "n", "epochs", "rest", "blocks", "before", "at", "whole", "picked", "t")
    )
    tokens = words(F.col(text_col))
    rows = docs.withColumns(
        {
            group: F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            count: tokens,
            key: F.xxhash64(F.col(id_col), F.col(text_col)),
        }
    )
    totals = {r[0]: r[1] for r in rows.groupBy(group).agg(F.sum(count)).collect()}
    plan = [
        (x, w, b // max(1, totals[x]), b % max(1, totals[x]), max(1, totals[x] // BLOCK_TOKENS))
        for x, (w, b) in source_budgets(totals, max_repeat, target_entropy, budget).items()
    ]
    schema = f"{group} string, {p}weight double, {epochs} long, {rest} long, {blocks} long"
    sources = small(docs.sparkSession.createDataFrame(plan, schema))
    rows = rows.join(sources, group).withColumn(block, F.pmod(F.xxhash64(key, F.lit(seed)), F.col(blocks)))

    def place(epoch: str):
        """A block's place in an epoch's permutation."""
        return F.xxhash64(group, block, F.lit(seed), F.col(epoch).cast("long"))

    narrow = rows.where((F.col(rest) > 0) & (F.col(count) > 0)).groupBy(group, block, key).agg(
        F.sum(count).alias(t), F.first(rest).alias(rest), F.first(epochs).alias(epochs)
    )
    narrow = saved(narrow, "mix")
    sizes = narrow.groupBy(group, block).agg(F.sum(t).alias(t), F.first(rest).alias(rest), F.first(epochs).alias(epochs))
    order = Window.partitionBy(group).orderBy(place(epochs), block).rowsBetween(Window.unboundedPreceding, -1)
    cut = sizes.withColumn(before, F.coalesce(F.sum(t).over(order), F.lit(0))).where(F.col(before) < F.col(rest))
    fits = F.col(before) + F.col(t) <= F.col(rest)
    whole = cut.where(fits).select(group, block, F.lit(True).alias(whole_))
    last = cut.where(~fits).select(group, block, before)
    inside = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed), epochs), key)
    so_far = F.sum(t).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(t)
    picked = (
        narrow.join(small(last), [group, block])
        .withColumn(at, F.col(before) + so_far)
        .where(F.col(at) < F.col(rest))
        .select(group, key, F.lit(True).alias(picked_))
    )
    taken = rows.join(small(whole), [group, block], "left").join(small(picked), [group, key], "left")
    partial = (F.col(count) > 0) & (F.coalesce(whole_, F.lit(False)) | F.coalesce(picked_, F.lit(False)))
    times = F.when(F.col(count) == 0, 1).otherwise(F.col(epochs) + partial.cast("int")).cast("int")
    turns = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return taken.withColumn("epoch", F.explode(turns)).select(
        *names,
        F.col(count).alias("n_tokens"),
        F.col(f"{p}weight").alias("weight"),
        "epoch",
        F.col(block).alias("block"),
        place("epoch").alias("place"),
    )
