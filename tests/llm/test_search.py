"""Spelling variants, ranked search and language-model scores against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import pitman_yor, queries, ranked_search, spelling
from tidemark.llm.pitman_yor import START

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# -- 11: spelling variants -------------------------------------------------------------------------


def plain_words(rows, every=31, least=7, often=2):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def plain_variants(words, ratio=10):
    near, masks = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :]].append(w)
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in masks.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(
        ((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()),
        key=lambda r: r[0],
    )


def test_spelling_variants_equal_plain_version(spark, docs, folder):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1] or "") < 100_000] + [r for r in rows if len(r[1] or "") >= 100_000]
    got = sorted(map(tuple, queries.op11_spelling_variants(spark, folder).collect()))
    want = plain_variants({w: n for w, n in plain_words(rows).items()})
    assert got == want and any(r[1] for r in got)


@pytest.mark.parametrize("bucket_pairs", [0, 3, 1_000_000])
def test_near_pairs_come_once_whatever_the_buckets(spark, bucket_pairs):
    rng = np.random.default_rng(bucket_pairs)
    words = {"".join(rng.choice(list("abé"), rng.integers(2, 9))) for _ in range(600)} | {"aaaaaaa", "aaaaaaaa", "z" * 3_000, "z" * 2_999}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(df, bucket_pairs).collect()]
    want = set()
    for w in words:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in words:
                want.add((x, w))
            for c in "abéz":
                if c != w[i] and (x := w[:i] + c + w[i + 1 :]) in words and x > w:
                    want.add((w, x))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_forms_are_followed_to_the_last(spark):
    rows = [("abcdefgh", 1), ("abcdefgx", 10), ("abcdefyx", 100), ("abcdezyx", 10_000), ("abcdezyy", 10_000), ("qqqqqqq", 5)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit("clash"))
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()}
    assert got["abcdefgh"] == ("abcdefgx", "abcdezyx", 1, 10) and got["abcdefyx"] == ("abcdezyx", "abcdezyx", 2, 10_000)
    assert got["abcdezyx"] == (None, "abcdezyx", 2, None) and got["qqqqqqq"] == (None, "qqqqqqq", 0, None)
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_spelling_of_nothing(spark, empty):
    assert spelling.spelling_variants(spelling.noisy_word_counts(empty)).count() == 0


def test_long_runs_have_the_same_checksum():
    texts = ["x" * 100 + " é" * 3, None, "", "ab" * 40 + "×cd"]
    letters, doc, _, starts, ends, points = spelling._runs(pa.array(texts))
    before = np.array([zlib.crc32(b"1:")] * 4, np.uint32)
    crc = spelling._crc(letters, starts, ends, before[doc])
    runs = [r.encode() for t in texts for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    assert crc.tolist() == [zlib.crc32(b"1:" + r) for r in runs] and points.tolist() == [len(r.decode()) for r in runs]


# -- 12: ranked search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k=20):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, tf) for i, tf in docs if tf]
    total, df = sum(sum(tf.values()) for _, tf in docs), Counter(t for _, tf in docs for t in tf)
    out = []
    for item, text in sorted(items, key=str):
        scored = []
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        for i, tf in docs:
            m = 75 + (25 * sum(tf.values()) * len(docs)) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                for t, times in asked.items()
                if t in tf
            )
            if score > 0:
                scored.append((-score, i is not None, i, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(scored[:k], 1)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("settings", [{}, {"DOCS": 64, "CELLS": 100, "STEP": 1}])
def test_search_equals_plain_version(spark, docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ranked_search, name, value)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text", F.lit(1).alias("rank"))
    odd = [(900, None), (901, ""), (902, "the the of ending"), (None, "orbit lattice"), (903, "naïve ไทย \U0001f600 x")]
    more = spark.createDataFrame([(*x, 1) for x in odd + odd[2:3]], "item_id long, text string, rank int")
    items = items.unionByName(more)
    got = ranked_search.search(docs.withColumn("score", F.lit("clash")), items, k=7).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_search(rows, {tuple(r) for r in items.select("item_id", "text").collect()}, k=7)
    assert ordered(got) == ordered(want)
    if settings:
        again = ranked_search.search(docs, items, k=7, pairs_a_pass=20).collect()
        assert ordered(again) == ordered(want)


def test_search_stops_early_and_reads_ties(spark):
    """A task that knows 3 good scores reads few places of a list; of equal scores the lowest ids come first."""
    hashes = np.sort(np.arange(1, 5, dtype=np.uint64))
    asked = ranked_search.Queries(np.zeros(4, np.int64), hashes.view(np.int64), np.ones(4, np.int64), np.full(4, 1000))
    n = 4000
    ids = np.arange(n)[::-1].copy()
    m = np.full(n, 100)
    tf = np.ones(4 * n, np.int64)
    tf[:12] = 50  # three documents that have every term often
    block = ranked_search.Block(asked, ids, m, np.repeat(np.arange(n), 4), np.tile(hashes, n), tf)
    scores, best, depth = block.best(asked.terms, asked.times, 3, np.empty(0, np.int64), np.empty(0, np.int64))
    assert best.tolist() == [n - 3, n - 2, n - 1] and depth <= 2 * ranked_search.STEP
    scores, best, depth = block.best(asked.terms, asked.times, 5, np.empty(0, np.int64), np.empty(0, np.int64))
    assert best.tolist()[3:] == [0, 1] and depth >= n


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(docs, items.where("item_id = 0")).count() == 0
    assert ranked_search.search(docs, items.withColumn("text", F.lit("qwertyuiopasdf"))).count() == 0


# -- 13: language-model scores ---------------------------------------------------------------------


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def keys_of(words):
    """The 64-bit names that draws hash: of a word, and of a word in a context."""
    text, word, _ = pitman_yor.tokens(pa.array([w for w in words if w is not None], pa.string()))
    named = word[np.append(True, text[1:] != text[:-1])] if len(text) else word
    return dict(zip([w for w in words if w is not None], named)) | {None: pitman_yor.END}


def plain_draw(c, others, p, u, more, discount, strength, exact):
    """Tables by summing over all seatings in plain floats; then steps of a sixteenth."""
    size = min(c, exact)
    weights, product = [], 1.0
    seatings = [[0.0] * (size + 1) for _ in range(size + 1)]
    seatings[1][1] = 1.0
    for n in range(1, size):
        for t in range(1, n + 2):
            seatings[n + 1][t] = seatings[n][t - 1] + max(n - t * discount, 0) * seatings[n][t]
    for t in range(1, size + 1):
        product *= (strength + discount * (others + t - 1)) * p
        weights.append(product * seatings[size][t])
    total, run, t = sum(weights), 0.0, 1
    for w in weights:
        run += w
        t += run < u * total
    t, seated, step = min(t, size), size, 1
    while seated < c:
        many = min(c - seated, max(1, seated // 16))
        opening = (strength + discount * (others + t)) * p
        t += min(int(many * opening / (opening + seated - discount * t) + more(step)), many)
        seated, step = seated + many, step + 1
    return t


def plain_model(texts, burn_in=2, samples=3, exact=20):
    c = Counter()
    for text in texts:
        last = START
        for word in plain_tokens(text):
            c[word, last] += 1
            last = word and word[-1]
    names = keys_of({w for w, _ in c})
    codes = {x: START if x == START else int.from_bytes(x.encode(), "big") + 1 for _, x in c}
    key = {(w, x): pitman_yor._types(np.array([names[w]]), np.array([codes[x]])) for w, x in c}
    word_key = {w: pitman_yor.mixed(np.array([names[w]])) for w, _ in c}

    def drawn(keys, turn):
        return float(pitman_yor.uniforms(keys, turn)[0])

    by_word = Counter(w for w, _ in c)
    n = [list(c.values()).count(i) for i in (1, 2)], [list(by_word.values()).count(i) for i in (1, 2)]
    d1, d0 = (min(max(a / (a + 2 * b) if a else 0.5, 0.05), 0.95) for a, b in n)
    t, z = dict.fromkeys(c, 1), dict.fromkeys(by_word, 1)
    size, states = len(by_word), []

    def sums():
        tables, root = Counter(), Counter()
        for (w, x), k in t.items():
            tables[x] += k
            root[w] += k
        return tables, root, sum(z.values())

    for turn in range(1, burn_in + samples + 1):
        tables, root, all_z = sums()
        base, new = (1 + d0 * all_z) / (size + 1), {}
        for (w, x), n in c.items():
            left = root[w] - t[w, x]
            p = (left - d0 * min(z[w], left) + base) / (1 + sum(root.values()) - t[w, x])
            more = lambda step, k=key[w, x]: drawn(k, turn * 1000 + step)
            new[w, x] = plain_draw(n, tables[x] - t[w, x], p, drawn(key[w, x], turn), more, d1, 1.0, exact)
        t = new
        _, root, _ = sums()
        z = {
            w: plain_draw(
                root[w], all_z - z[w], 1 / (size + 1), drawn(word_key[w], turn),
                lambda step, k=word_key[w]: drawn(k, turn * 1000 + step), d0, 1.0, exact,
            )
            for w in z
        }
        if turn > burn_in:
            states.append((dict(t), dict(z), *sums()))
    customers = Counter()
    for (_, x), n in c.items():
        customers[x] += n

    def probability(w, x):
        out = []
        for t, z, tables, root, all_z in states:
            p = (root[w] - d0 * z.get(w, 0) + (1 + d0 * all_z) / (size + 1)) / (1 + sum(root.values()))
            own = c[w, x] - d1 * t[w, x] if (w, x) in c else 0.0
            out.append((own + (1 + d1 * tables[x]) * p) / (1 + customers[x]))
        return sum(out) / len(out)

    counts = Counter()
    for (w, _), n in c.items():
        counts[w] += n
    return probability, counts


@pytest.mark.parametrize("hot_types", [0, 500, 1 << 21])
def test_scores_equal_plain_version(spark, docs, monkeypatch, hot_types):
    monkeypatch.setattr(pitman_yor, "EXACT", 20)
    some = docs.where("doc_id IS NULL OR doc_id < 40").where("text IS NULL OR length(text) < 30000").select("doc_id", "text", "n")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    probability, counts = plain_model([text for i, text in rows if not held[i]])
    learned = some.where(~pitman_yor.held_out("doc_id", 10, 0)).select("text")
    model = pitman_yor.train(learned)
    got = pitman_yor.score(some, model, hot_types=hot_types).collect()
    all_n, floor = counts.total(), counts.total() + 0.1 * (len(counts) + 1)
    want = []
    for i, text in rows:
        words = plain_tokens(text)
        lasts = [START, *(w[-1] for w in words[:-1])]
        base = sum(math.log10((counts[w] + 0.1) / floor) for w in words)
        own = sum(math.log10(probability(w, x)) for w, x in zip(words, lasts))
        want.append((i is None, i or 0, len(words), sum(counts[w] > 0 for w in words), base, own))
    have = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got]
    assert {r.train_tokens for r in got} == {all_n} and len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-6)


def test_probabilities_sum_to_one_and_held_out_texts_gain(spark, folder):
    rows = queries.op13_pitman_yor(spark, folder).cache()
    own, base = ({r.held_out: r.perplexity for r in pitman_yor.perplexity(rows, c).collect()} for c in ("score", "base_score"))
    assert own[True] < 0.8 * base[True] and own[False] < own[True]
    model = pitman_yor.train(spark.createDataFrame([("a b a c.",), ("a b",), (None,), ("b. a é",)], "text string"))
    vocabulary = ["a", "b", "c.", "b.", "é"]
    contexts = ["", "a", "b", ".", "é", "new"]
    texts = [(i * 100 + j, f"{x} {w}") for i, x in enumerate(contexts) for j, w in enumerate([*vocabulary, "zzz", ""])]
    scores = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c."), (3, "b."), (4, "é"), (5, "zzz"), (6, "")], "doc_id long, text string")
    ends = {r.doc_id: r.score for r in pitman_yor.score(df, model).collect()}
    # The first token's probabilities, from p(word, end) / p(end | word): over the vocabulary, one unknown word and the end.
    after = {r.doc_id: r.score for r in pitman_yor.score(df.selectExpr("doc_id", "concat(text, ' ', text) AS text"), model).collect()}
    assert len(scores) == len(texts) and len(after) == 7
    one = sum(10 ** (ends[i] - _end_after(model, w)) for i, w in enumerate([*vocabulary, "zzz"])) + 10 ** ends[6]
    assert one == pytest.approx(1.0, abs=1e-9)


def _end_after(model, word):
    """log10 of the probability of an end after a word."""
    end = model.words.where("w = 0").first()
    code = int.from_bytes(word[-1].encode(), "big") + 1
    if code in end.ctx:
        return end.lp[end.ctx.index(code)]
    weights = model.back_off(np.array([code]))[0]
    return math.log10(float(np.mean(weights * np.array(end.roots))))


def plain_word_model(texts, burn_in=2, samples=3, exact=20, hot_words=1 << 19):
    """The model whose contexts are whole words, with every pair sampled in plain Python."""
    c, counts = Counter(), Counter()
    for text in texts:
        before = None
        for word in plain_tokens(text):
            c[word, before] += 1
            counts[word] += 1
            before = word
    names = keys_of(counts)
    ranked = sorted(counts, key=lambda w: (-counts[w], names[w]))
    levels = {w: math.floor(math.log2(counts[w]) * 8) for w in counts}
    reach = np.cumsum(np.bincount(list(levels.values()))[::-1])[::-1]
    hot = {w: i for i, w in enumerate(ranked) if reach[levels[w]] <= hot_words}
    codes = {w: np.int64(hot[w]) if w in hot else (names[w] | np.uint64(1 << 63)).view(np.int64) for w in counts}
    key = {(w, u): pitman_yor._pairs(np.array([codes[w]]), np.array([codes[u]])) for w, u in c}
    word_key = {w: pitman_yor.mixed(np.array([codes[w]]).view(np.uint64)) for w in counts}
    dishes = Counter(w for w, _ in c)
    n = [list(x.values()).count(i) for x in (c, dishes) for i in (1, 2)]
    d1, d0 = (min(max(a / (a + 2 * b) if a else 0.5, 0.05), 0.95) for a, b in (n[:2], n[2:]))
    t, z, size, states = dict.fromkeys(c, 1), dict.fromkeys(counts, 1), len(counts), []

    def drawn(keys, turn):
        return float(pitman_yor.uniforms(keys, turn)[0])

    def sums():
        tables, root = Counter(), Counter()
        for (w, u), k in t.items():
            tables[u] += k
            root[w] += k
        return tables, root, sum(z.values())

    for turn in range(1, burn_in + samples + 1):
        tables, root, all_z = sums()
        base, all_k, new = (1 + d0 * all_z) / (size + 1), sum(root.values()), {}
        for (w, u), k in c.items():
            left = root[w] - t[w, u]
            p = (left - d0 * min(z[w], left) + base) / (1 + all_k - t[w, u])
            more = lambda step, x=key[w, u]: drawn(x, turn * 1000 + step)
            new[w, u] = plain_draw(k, tables[u] - t[w, u], p, drawn(key[w, u], turn), more, d1, 1.0, exact)
        t = new
        _, root, _ = sums()
        z = {
            w: plain_draw(
                root[w], all_z - z[w], 1 / (size + 1), drawn(word_key[w], turn),
                lambda step, x=word_key[w]: drawn(x, turn * 1000 + step), d0, 1.0, exact,
            )
            for w in z
        }
        if turn > burn_in:
            states.append((dict(t), dict(z), *sums(), sum(root.values())))

    def probability(w, u):
        out = []
        for t, z, tables, root, all_z, all_k in states:
            p = (root[w] - d0 * z.get(w, 0) + (1 + d0 * all_z) / (size + 1)) / (1 + all_k)
            own = c[w, u] - d1 * t[w, u] if (w, u) in c else 0.0
            out.append((own + (1 + d1 * tables[u]) * p) / (1 + counts[u]))
        return sum(out) / len(out)

    return probability, counts


@pytest.mark.parametrize("hot_words, hot_pairs, bits", [(0, 0, 27), (60, 40, 4), (1 << 19, 1 << 21, 27)])
def test_word_contexts_equal_plain_version(spark, docs, monkeypatch, hot_words, hot_pairs, bits):
    monkeypatch.setattr(pitman_yor, "EXACT", 20)
    monkeypatch.setattr(pitman_yor, "BITS", bits)
    some = docs.where("doc_id IS NULL OR doc_id < 40").where("text IS NULL OR length(text) < 10000").select("doc_id", "text", "n")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    assert any(held.values())
    probability, counts = plain_word_model([text for i, text in rows if not held[i]], hot_words=hot_words)
    got = pitman_yor.corpus_scores(some, hot_words=hot_words, hot_pairs=hot_pairs).collect()
    floor = counts.total() + 0.1 * (len(counts) + 1)
    want = []
    for i, text in rows:
        words = plain_tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / floor) for w in words)
        own = sum(math.log10(probability(w, u)) for w, u in zip(words, [None, *words]))
        want.append((i is None, i or 0, held[i], len(words), sum(counts[w] > 0 for w in words), base, own))
    have = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got]
    assert {r.train_tokens for r in got} == {counts.total()} and len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_context_is_the_whole_word_before(spark):
    """After two words that end alike, what follows differs; with the last character as context it did not."""
    texts = [(i, "sand wet") for i in range(1, 30)] + [(i, "band loud") for i in range(31, 60)]
    asked = [(100, "sand wet"), (101, "sand loud"), (102, "band wet"), (103, "band loud")]
    rows = spark.createDataFrame(texts + asked, "doc_id long, text string")
    score = {r.doc_id: r.score for r in pitman_yor.corpus_scores(rows).collect()}
    assert score[100] > score[101] + 0.7 and score[103] > score[102] + 0.7


def test_rows_beside_rare_words_hold_numbers_only(spark):
    """Lists that are null cost a batch of rows its square: Spark sizes an Arrow batch after each row."""
    rows = spark.createDataFrame([(1, 2, 3), (-5, 2, 1), (1, -5, 1), (-5, -7, 2)], "w long, u long, c long")
    rare = spark.createDataFrame([(-5, 4, 0.5, 0.25)], "key long, c long, roots0 double, weights0 double")
    got = pitman_yor._with_rare(rows, rare, ["c", "roots0"], ["weights0"])
    assert not any(kind.startswith("array") for _, kind in got.dtypes)
    want = {(1, 2, 3, None, None, None), (-5, 2, 1, 4, 0.5, None), (1, -5, 1, None, None, 0.25), (-5, -7, 2, 4, 0.5, None)}
    assert {tuple(r) for r in got.select("w", "u", "c", "w_c", "w_roots0", "u_weights0").collect()} == want


def test_tables_are_drawn_from_all_seatings():
    """Seating customers one by one by the restaurant's rule, weighted to one dish, gives the drawn distribution."""
    c, others, p, discount, strength = 5, 3, 0.2, 0.6, 1.0
    chances = Counter()

    def seat(sizes, seated, weight):
        if seated == c:
            chances[len(sizes)] += weight
            return
        for i, s in enumerate(sizes):
            seat([*sizes[:i], s + 1, *sizes[i + 1 :]], seated + 1, weight * (s - discount))
        seat([*sizes, 1], seated + 1, weight * (strength + discount * (others + len(sizes))) * p)

    seat([], 0, 1.0)
    n = 40_000
    keys = pitman_yor.mixed(np.arange(n, dtype=np.uint64))
    got = pitman_yor.draw_tables(
        np.full(n, c), np.full(n, others), np.full(n, p), keys, 1, discount, strength, pitman_yor.log_stirling(discount, 16)
    )
    for t, weight in chances.items():
        assert (got == t).mean() == pytest.approx(weight / sum(chances.values()), abs=0.01)


def test_scores_of_nothing(spark, empty):
    assert pitman_yor.corpus_scores(empty).count() == 0
    got = pitman_yor.corpus_scores(spark.createDataFrame([(12, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.train_tokens + 0) for r in got] and got[0].score <= 0
