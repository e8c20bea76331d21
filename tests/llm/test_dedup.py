"""Near-duplicate operators against brute force over all pairs."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import components as walks
from tidemark.llm import embedding_dedup, jaccard_join, queries
from tidemark.llm.components import components


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(width))))


def linked(rows, width, percent):
    """Shingle sets of ``(id, text)`` rows and the class of each row."""
    sets = [shingles(t, width) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    both = Counter((a, b) for held in holders.values() for i, a in enumerate(held) for b in held[:i])
    edges = [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return sets, roots(range(len(rows)), edges)


def jaccard_brute(rows, width, percent):
    """Bag of (id, set size, component) of ``(id, text)`` rows."""
    sets, root = linked(rows, width, percent)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    return Counter((key, len(sets[i]), least.get(root[i])) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_classes_equal_all_pairs(docs, width, percent):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_join.jaccard_classes(docs, width=width, percent=percent).collect()
    assert Counter(map(tuple, got)) == jaccard_brute(rows, width, percent)


def test_chains_and_shared_passages(spark):
    """Texts edited step by step link in a chain; texts that share a passage only do not."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    text, passage, rows = words(300), words(60), []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[rng.randrange(300)] = words(1)[0]
    rows += [(100 + i, " ".join(words(40) + passage + words(40))) for i in range(60)]
    rows += [(200 + i, " ".join(passage + words(i % 7))) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80)):
        got = Counter(map(tuple, jaccard_join.jaccard_classes(df, width, percent).collect()))
        assert got == jaccard_brute(rows, width, percent)


def test_only_sets_of_candidate_pairs_are_cut(spark, monkeypatch):
    """Texts that share a shingle or two by chance are compared by sketches; before, all of them were cut and shuffled."""
    rng = random.Random(11)
    some = [" ".join(f"s{rng.randrange(10**9)}" for _ in range(3)) for _ in range(20)]
    texts = [" ".join([*(f"w{rng.randrange(10**9)}" for _ in range(40)), some[i % 20]]) for i in range(100)]
    rows = [*enumerate(texts), (100, texts[5] + " more")]
    cut, fragments = [], jaccard_join._fragments
    monkeypatch.setattr(
        jaccard_join, "_fragments", lambda owners, *rest: cut.extend(r.digest for r in owners.collect()) or fragments(owners, *rest)
    )
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard_join.jaccard_classes(df, 3, 90).collect()))
    assert got == jaccard_brute(rows, 3, 90) and len(set(cut)) == 2


def check_dropped(before, after, width=5, percent=80):
    """One row of the smallest id of every class of texts with words, and all texts without."""
    sets, root = linked(before, width, percent)
    members = {}
    for i, (key, text) in enumerate(before):
        if sets[i] and key is not None:
            members.setdefault(root[i], []).append((key, text))
    want = Counter(min(k for k, _ in m) for m in members.values())
    with_words = [(k, t) for k, t in after if shingles(t, width) and k is not None]
    assert Counter(k for k, _ in with_words) == want
    assert len(set(with_words)) == len(with_words) and set(with_words) <= set(before)
    blank = lambda rows: Counter(r for r in rows if not shingles(r[1], width))
    assert blank(before) == blank(after)


def test_drop_copies_keeps_one_of_each(docs):
    kept = jaccard_join.drop_copies(docs)
    assert kept.columns == docs.columns
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    check_dropped(pairs(docs), pairs(kept))


def test_components_of_long_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 100), (200, 200), (100, 200), (7, 200)]
    edges = [(hash((a, 5)) % 10**6, hash((b, 5)) % 10**6) for a, b in edges]
    nodes = {x for e in edges for x in e}
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {n: got.get(n, n) for n in nodes} == roots(nodes, edges)


def test_few_edges_and_many_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(200)] + [(None, 3), (4, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = sorted(tuple(r) for r in components(df).collect())
    monkeypatch.setattr(walks, "FEW", -1)
    many = sorted(tuple(r) for r in components(df).collect())
    own = [e for e in edges if None not in e]
    want = roots({x for e in own for x in e}, own)
    assert few == many == sorted((n, r) for n, r in want.items() if n != r)


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 24)))]
    for i in range(200):
        base = np.array(rows[rng.integers(0, 30)][1])
        rows.append((1000 + i, (3 * (base + rng.standard_normal(24) * rng.uniform(0.05, 0.5))).tolist()))
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [rows[1], rows[1]]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (3004, [1.0, None]), (3005, [float("inf")] * 24)]
    return rows + [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [-0.0, 1.0]), (3009, [0.0, 1.0]), (None, rows[2][1])]


def test_embedding_links_equal_all_pairs(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = embedding_dedup.near_duplicates(df).collect()
    unit = [None] * len(rows)
    for i, (_, v) in enumerate(rows):
        x = np.array(v or [], float) if v is None or None not in v else np.array([np.nan])
        if len(x) and np.isfinite(x).all() and x.any():
            unit[i] = x / np.linalg.norm(x)
    edges = [
        (i, j) for i, a in enumerate(unit) if a is not None for j in range(i)
        if unit[j] is not None and len(unit[j]) == len(a) and a @ unit[j] >= 0.9
    ]
    root, links, least = roots(range(len(rows)), edges), Counter(x for e in edges for x in e), {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    want = Counter(
        (k, links[i], least.get(root[i]), k is not None and k == least.get(root[i])) for i, (k, _) in enumerate(rows)
    )
    found = Counter(tuple(r) for r in got)
    # The index is approximate at the threshold itself.
    assert sum(r.n_links for r in got) >= 0.99 * sum(links.values())
    assert sum((want - found).values()) <= 0.02 * len(rows)


def test_blocks_count_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.05 * rng.standard_normal(16)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    got = embedding_dedup.near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_no_vector_or_no_row(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    rows = embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 1, True), (2, 0, 2, True)]
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op1_embedding_dedup(spark, str(tmp_path)).collect() == []


def test_registered_embedding_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in queries.op1_embedding_dedup(spark, SMALL).collect()}
    assert got == {r.vec_id: n for r, n in zip(rows, links.tolist())}


def test_saved_tables_leave_no_shuffled_data(spark):
    """Before, what was shuffled for a saved table lay on disk until the driver's garbage was collected."""
    from tidemark.llm.common import CLEANUP, saved

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    spark.conf.set(CLEANUP, "false")
    try:
        before = names()
        table = saved(spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS k").groupBy("k").count(), "sums")
        for _ in range(50):
            if not (left := names() - before):
                break
            time.sleep(0.1)
        assert not left
        assert spark.conf.get(CLEANUP) == "false"
        assert table.agg({"count": "sum"}).first()[0] == 1000
    finally:
        spark.conf.unset(CLEANUP)
