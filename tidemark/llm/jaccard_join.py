"""N-gram Jaccard join by vertical partitioning.

The distinct word shingles of all texts have one global order: rare before frequent, then by hash. Two sets that are
similar enough share a shingle among the first few of each in that order, so only those prefixes are shuffled to find
candidate pairs, and a passage that many documents carry stands last and seldom makes a candidate. To verify, the
shingle space is cut into hash fragments: each fragment of each set is a row of its own, the overlaps of a pair are
counted fragment by fragment and summed per pair, so no task needs a whole set.

Equal sets are one node from the start. Each bucket (the sets that share a prefix shingle) first links its members to
one leader. What is still apart meets in rounds: every set goes to the bucket of its least prefix shingle by the round's
hash, as most of its near copies do, and is compared there with a few leaders, so a round costs as much as there are sets
and families of any size grow together. Only then come the pairs that are left, those of each set with its nearest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, in_bits, key_bits, list_parts, long_lists, saved, small, text_bytes, unshuffled
from tidemark.llm.components import components
from tidemark.llm.shingles import mixed, set_digest, shingle_sets

#: Frequent shingles that are told apart in the global order: at most so many, each in at least so many sets.
FREQUENT, LEAST_SETS = 1 << 18, 4
#: Shingles a task gathers before it counts them; bounds its memory.
GATHER = 4_000_000
#: Fragments of the shingle space in verification.
FRAGMENTS = 16
#: 64-bit words of the parity bitmap that bounds a pair's difference from below.
PARITY = 16
BITS = 26
#: Rounds of meetings at most (more only save pairs afterwards), buckets a set goes to and leaders it meets in each.
ROUNDS, MEETINGS, LEADERS = 8, 2, 4


def _frequent(sets: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the binary logarithm of their counts.

    Tasks send on only what they see twice; the counts steer the order and never a result.
    """

    def count(parts):
        seen, held, n = set(), [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["item", "n"]
            )

        for batch in parts:
            for items in shingle_sets(batch.column(0), width):
                if len(items) and (digest := set_digest(items)) not in seen:
                    seen.add(digest)
                    held.append(items)
                    n += len(items)
                    if n >= GATHER:
                        yield flush()
                        seen, held, n = set(), [], 0
        if held:
            yield flush()

    most = (
        arrow_map(sets, count, "item long, n long")
        .groupBy("item")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_SETS)
        .orderBy(F.desc("n"), "item")
        .limit(FREQUENT)
    )
    with unshuffled(sets.sparkSession):
        rows = most.toArrow()
    items = np.asarray(rows.column("item").combine_chunks()).view(np.uint64)
    level = np.log2(np.asarray(rows.column("n").combine_chunks()).astype(float)).astype(np.int8)
    order = np.argsort(items)
    return items[order], level[order]


def _prefixes(texts: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """Per document its set's size and digest and, once per set and task, the set's prefix and parity bitmap."""
    spread = texts.sparkSession.sparkContext.broadcast(frequent)

    def rows(parts):
        known, level = spread.value
        seen = set()
        for batch in parts:
            n, digests, prefixes, parities = [], [], [], []
            for items in shingle_sets(batch.column("text"), width):
                n.append(len(items))
                digest = set_digest(items) if len(items) else None
                digests.append(digest)
                if digest is None or digest in seen:
                    prefixes.append(None)
                    parities.append(None)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(digest)
                first = len(items) - -(-percent * len(items) // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
                    rank = np.where(known[at] == items, level[at], 0)
                    items_in_order = items[np.argsort(rank, kind="stable")[:first]] if rank.any() else items[:first]
                else:
                    items_in_order = items[:first]
                prefixes.append(items_in_order)
                odd = np.bincount((mixed(items) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("key"),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.int64()),
                    long_lists(prefixes),
                    long_lists(parities),
                ],
                ["id", "key", "n", "digest", "prefix", "parity"],
            )

    return arrow_map(texts, rows, "id long, key long, n long, digest long, prefix array<long>, parity array<long>")


def _buckets(table: DataFrame, shared) -> DataFrame:
    """``(item, node, n, at)``: the sets that hold a prefix shingle which some other set's prefix holds as well."""

    def rows(parts):
        flat = shared.value
        for batch in parts:
            values, sizes = list_parts(batch.column("prefix"))
            if not len(values):
                continue
            keep = in_bits(flat, values, BITS)
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            at = (np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]
            node = np.asarray(batch.column("digest").fill_null(0))[row]
            n = np.asarray(batch.column("n"))[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[keep].view(np.int64)), pa.array(node), pa.array(n), pa.array(at)],
                ["item", "node", "n", "at"],
            )

    return arrow_map(table, rows, "item long, node long, n long, at long").distinct()


def _may_link(percent: int, a: str = "a", b: str = "b") -> str:
    """What sizes and places of a shared prefix shingle allow; ``a`` is the smaller set."""
    return (
        f"100 * {a}.n >= {percent} * {b}.n AND (100 + {percent}) * least({a}.n - {a}.at, {b}.n - {b}.at)"
        f" >= {percent} * ({a}.n + {b}.n)"
    )


def _early(percent: int) -> str:
    """The place that the smaller set of a linked pair can have; the larger may have any place in its prefix."""
    return f"(100 + {percent}) * (n - at) >= {2 * percent} * n"


def _owners(nodes: DataFrame, parities: DataFrame) -> DataFrame:
    """``(digest, owner, n)``: of each set in ``nodes(digest)`` a row that has it, and its size."""
    return saved(parities.select("digest", "owner", "n").join(nodes.distinct(), "digest"), "owners")


def _fragments(owners: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(node, fragment, items)``: the sets of ``owners``, cut along the hash order."""
    by_owner, by_set = key_bits(owners, "owner", BITS - 3), key_bits(owners, "digest", BITS - 3)

    def fragments(parts):
        seen = set()
        for batch in parts:
            ids = np.asarray(batch.column("id").fill_null(0))
            batch = batch.filter(pa.array(in_bits(by_owner.value, ids, BITS - 3)))
            if not len(batch):
                continue
            node, fragment, items = [], [], []
            for whole in shingle_sets(batch.column("text"), width):
                digest = set_digest(whole) if len(whole) else None
                if digest is None or digest in seen:
                    continue
                if not in_bits(by_set.value, np.array([digest]), BITS - 3)[0]:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(digest)
                cut = np.searchsorted(whole >> np.uint64(32), np.arange(1, FRAGMENTS) * ((1 << 32) // FRAGMENTS))
                for k, part in enumerate(np.split(whole, cut)):
                    if len(part):
                        node.append(digest)
                        fragment.append(k)
                        items.append(part)
            if node:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), long_lists(items)],
                    ["node", "fragment", "items"],
                )

    return saved(arrow_map(texts, fragments, "node long, fragment int, items array<long>"), "fragments")


def _verified(pairs: DataFrame, parities: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of set digests whose summed fragment overlaps reach the threshold.

    Only sets of these pairs are cut: they are few beside those that share a shingle by chance, which never move.
    """
    owners = _owners(_ends(pairs), parities)
    parts = _fragments(owners, texts, width)
    a, b = (
        parts.select(F.col("node").alias(x), "fragment", F.col("items").alias(f"{x}_items")) for x in ("a", "b")
    )
    overlaps = (
        pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
        .join(b, ["b", "fragment"])
        .join(a, ["a", "fragment"])
        .select("a", "b", "fragment", F.size(F.array_intersect("a_items", "b_items")).cast("long").alias("both"))
        # A set that two tasks cut gives equal rows.
        .groupBy("a", "b", "fragment")
        .agg(F.max("both").alias("both"))
        .groupBy("a", "b")
        .agg(F.sum("both").alias("both"))
    )
    sizes = [owners.select(F.col("digest").alias(x), F.col("n").alias(f"{x}_n")) for x in ("a", "b")]
    linked = overlaps.join(sizes[0], "a").join(sizes[1], "b")
    return linked.where(f"100 * both >= {percent} * (a_n + b_n - both)").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest")))


def _parities(table: DataFrame) -> DataFrame:
    """``(digest, n, owner, w0, w1, ...)``: each set's size, a row that has it and its parity bitmap, once."""
    words = (F.first(F.col("parity")[i]).alias(f"w{i}") for i in range(PARITY))
    own = (F.first("n").alias("n"), F.min(F.coalesce("id", F.lit(0))).alias("owner"))
    return saved(table.where("parity IS NOT NULL").groupBy("digest").agg(*own, *words), "parities")


def _differ() -> str:
    return " + ".join(f"bit_count(a.w{i} ^ b.w{i})" for i in range(PARITY))


def _near(percent: int) -> str:
    """Whether two bitmaps ``a`` and ``b`` allow a link.

    A shingle in one set only flips one parity bit, so two bitmaps differ in at most as many bits as the sets do in
    shingles.
    """
    return f"(100 + {percent}) * ({_differ()}) <= {100 - percent} * (a.n + b.n)"


def _open(rows: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The rows of buckets, with the roots they have by now, whose sets are not all joined; three sets or more."""
    parted = rows.drop("root").join(roots.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
    parted = parted.withColumn("root", F.coalesce("root", "node")).drop("known")
    open_items = (
        parted.groupBy("item")
        .agg(
            F.min("root").alias("lo"),
            F.max("root").alias("hi"),
            F.count("*").alias("sets"),
            F.max(F.expr(_early(percent))).alias("early"),
        )
        .where("lo <> hi AND sets > 2 AND early")
        .select("item")
    )
    return saved(parted.join(open_items, "item"), "open")


def _smaller_first(percent: int) -> str:
    smaller = "(a.n < b.n OR a.n = b.n AND a.node < b.node)"
    return f"CASE WHEN {smaller} THEN {_may_link(percent)} ELSE {_may_link(percent, 'b', 'a')} END"


def _meetings(rows: DataFrame, parities: DataFrame, turn: int, percent: int) -> DataFrame:
    """Of each set the pair with the nearest of the few leaders that it meets in this round, if bounds allow a link."""
    pairs = None
    for seed in range(turn * MEETINGS, (turn + 1) * MEETINGS):
        least = rows.groupBy("node").agg(
            F.min(F.struct(F.xxhash64("item", F.lit(seed)).alias("h"), "item", "n", "at", "root")).alias("m")
        )
        guests = least.select("node", "m.item", "m.n", "m.at", "m.root")
        drawn = [
            F.min(F.struct(F.xxhash64("node", F.lit(seed * LEADERS + i)).alias("h"), "node", "n", "at", "root"))
            for i in range(LEADERS)
        ]
        leaders = guests.groupBy("item").agg(F.array_distinct(F.array(*drawn)).alias("l"), F.count("*").alias("sets"))
        leaders = leaders.where("sets > 1").select("item", F.explode("l").alias("l")).select("item", "l.*").drop("h")
        met = (
            guests.alias("a")
            .join(leaders.alias("b"), F.expr(f"a.item = b.item AND a.root <> b.root AND {_smaller_first(percent)}"))
            .select("a.node", F.col("b.node").alias("other"))
        )
        pairs = met if pairs is None else pairs.unionByName(met)
    near = (
        pairs.distinct()
        .join(parities.alias("a"), F.expr("node = a.digest"))
        .join(parities.alias("b"), F.expr(f"other = b.digest AND {_near(percent)}"))
        .select("node", "other", F.expr(_differ()).alias("differ"))
    )
    best = near.groupBy("node").agg(F.min(F.struct("differ", "other")).alias("best"))
    ends = (F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b"))
    return saved(best.select(*ends).distinct(), "meetings")


def _apart(rows: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs of open buckets that no link has joined yet and whose parity bitmaps allow a link."""
    rows = rows.join(parities.drop("n", "owner"), rows.node == parities.digest).drop("digest")
    pairs = (
        rows.where(_early(percent))
        .alias("a")
        .join(
            rows.alias("b"),
            F.expr(
                f"a.item = b.item AND a.root <> b.root AND (a.n < b.n OR a.n = b.n AND a.node < b.node)"
                f" AND {_may_link(percent)} AND {_near(percent)}"
            ),
        )
        .select(
            F.least("a.node", "b.node").alias("a"),
            F.greatest("a.node", "b.node").alias("b"),
            F.expr(_differ()).alias("differ"),
        )
        .distinct()
    )
    return saved(pairs, "apart-pairs")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)`` after more links: only the roots that those join are walked again."""
    of_a, of_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    ends = (
        links.join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .select("a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    )
    higher = components(saved(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "root-links"))
    above = higher.select(F.col("node").alias("old"), F.col("root").alias("new"))
    # Sets that were alone are roots of their own, and may now be under another.
    old = roots.join(above, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = higher.join(roots.select("node"), "node", "left_anti")
    return saved(old.unionByName(alone.select("node", "root")), "roots")


def _nearest(pairs: DataFrame) -> DataFrame:
    """For every set in ``pairs(a, b, differ)`` the pair with the set that differs least."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "differ"))
    best = both.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, n, root, component_id)`` per row; ``key`` is xxhash64 of the text, ``root`` the class's set."""
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width positive")
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), F.xxhash64(text_col).alias("key")
    )
    frequent = _frequent(texts.select("text"), width)
    table = saved(_prefixes(texts, width, percent, frequent), "prefixes")
    # What two sets share and their sizes and places allow is seen from sums over the bucket, without its rows.
    held = table.select(F.posexplode("prefix").alias("at", "item"), F.col("digest").alias("node"), "n")
    shared = (
        held.groupBy("item")
        .agg(
            F.min("node").alias("x"),
            F.max("node").alias("y"),
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
            F.min(F.col("n") - F.col("at")).alias("room"),
            F.count("*").alias("sets"),
            F.max(F.expr(_early(percent))).alias("early"),
        )
        .where("x <> y AND early")
        .select("item", "x", "y", "smallest", "largest", "room", "sets")
    )
    shared = saved(shared, "shared")
    twos = shared.where(
        f"sets = 2 AND 100 * smallest >= {percent} * largest"
        f" AND (100 + {percent}) * room >= {percent} * (smallest + largest)"
    ).select("x", "y")
    several = key_bits(shared.where("sets > 2"), "item", BITS)
    buckets = saved(_buckets(table.where("prefix IS NOT NULL"), several), "buckets")
    leaders = (
        buckets.groupBy("item")
        .agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n", "at")).alias("l"), F.count("*").alias("sets"))
        .where("sets > 1")
        .select("item", "l.node", "l.n", "l.at")
    )
    parities = _parities(table)
    star = saved(
        buckets.alias("a")
        .join(leaders.alias("b"), "item")
        .where("a.node <> b.node")
        .where(F.expr(_smaller_first(percent)))
        .select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y"))
        .unionByName(twos)
        .distinct()
        .join(parities.alias("a"), F.expr("x = a.digest"))
        .join(parities.alias("b"), F.expr(f"y = b.digest AND {_near(percent)}"))
        .select(F.col("x").alias("a"), F.col("y").alias("b")),
        "star",
    )
    links = saved(_verified(star, parities, texts, width, percent), "links")
    roots = components(links)
    rows = _open(buckets.withColumn("root", F.col("node")), roots, percent)
    if not rows.isEmpty():
        nodes = rows.select("node").distinct().count()
        for turn in range(ROUNDS):
            chosen = _meetings(rows, parities, turn, percent)
            if chosen.isEmpty():
                break
            found = saved(_verified(chosen, parities, texts, width, percent), "found")
            links = found.count()
            if not links:
                break
            roots = _joined(roots, found)
            rows = _open(rows, roots, percent)
            # Where few sets still find a link, the pairs that are left are few as well.
            if links * 50 < nodes:
                break
        # What is still apart: first each set with its nearest, then the rest.
        tested, pairs = star, _apart(rows, parities, percent)
        for choose in (_nearest, lambda left: left.select("a", "b")):
            of_a, of_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
            left = (
                pairs.join(of_a, "a", "left")
                .join(of_b, "b", "left")
                .where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
                .select("a", "b", "differ")
                .join(tested, ["a", "b"], "left_anti")
            )
            chosen = saved(choose(saved(left, "left")), "chosen")
            if chosen.isEmpty():
                break
            tested = tested.unionByName(chosen)
            roots = _joined(roots, saved(_verified(chosen, parities, texts, width, percent), "found"))
    firsts = table.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"))
    rooted = firsts.join(roots, F.col("digest") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("root", "digest").alias("root")
    )
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(classes, "root").select("digest", "root", "component_id")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return table.join(of, "digest", "left").select("id", "key", "n", "root", component.alias("component_id"))


def jaccard_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row: texts linked by word-shingle Jaccard similarity.

    Words are runs of anything but the six ASCII white-space bytes, A-Z lower-cased; a set holds the distinct
    ``width``-word shingles of the whole text, or the whole sequence if there are fewer words. Two texts link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id reachable by links. All links count:
    the prefixes, size and place bounds and parity bitmaps exclude no pair that reaches the threshold, and each
    remaining pair is verified by exact overlaps. Sets are told apart by 64-bit digests.

    Null, empty and blank texts have no shingles and link with nothing. Repeated rows stay, in one class. A null id
    gets its class's smallest other id, or null. Further columns are ignored. An empty table gives no rows.
    """
    rows = _classes(docs, width, percent, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_copies(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without those linked to an earlier one: of each class the row of the smallest id stays.

    Texts without words link with nothing and stay, as do rows whose class has null ids only. A row that is repeated
    with the same id and text stays once if it has words.
    """
    rows = saved(_classes(docs, width, percent, id_col, text_col).where("n > 0 AND component_id IS NOT NULL"), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("f")
    kept = rows.groupBy("root").agg(first, F.count("*").alias("of")).where("of > 1").select("root", "f.id", "f.key")
    kept = kept.withColumnsRenamed({"id": "kept_id", "key": "kept_key"})
    chosen = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    judged = rows.join(kept, "root").withColumn("chosen", chosen)
    judged = judged.groupBy("id", "key").agg(F.max("chosen").alias("chosen"), F.count("*").alias("of"))
    gone = small(judged.where("NOT chosen OR of > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "chosen"))
    here = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key"))
    left = docs.join(gone.drop("chosen"), here, "left_anti")
    again = gone.where("chosen")
    if again.isEmpty():
        return left
    once = docs.join(again.drop("chosen"), here).dropDuplicates(["_id", "_key"])
    return left.unionByName(once.select(*docs.columns))
