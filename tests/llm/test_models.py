"""Toxicity, language, mixing and licences: held-out accuracy and plain versions."""

from __future__ import annotations

import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import language_id, license_scan, mixing, queries, toxicity

MIDDLE = "/root/testdata/sf0.01"


def fold(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


def test_toxicity_holds_out_of_sample(spark):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, MIDDLE).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r.held_out == (fold(k, 5) == 0) and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(labels[k], r.predicted) for k, r in got.items() if r.held_out and k in labels]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)


def test_scores_depend_on_the_text_alone(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.toxic_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = defaultdict(set)
    model = toxicity.corpus_model(docs, labels)
    scored = toxicity.score(docs.withColumn("doc_id", F.xxhash64("text")), model)
    for r in scored.collect():
        by_text[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxic_scores(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 0, 1), (3, 0, 1)], none.schema)
    assert len({r.score for r in toxicity.toxic_scores(docs, odd).collect()}) == 1
    assert toxicity.toxic_scores(empty, none).collect() == []


def test_language_holds_out_of_sample(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, MIDDLE).collect()}
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    held = [(r.lang, got[r.doc_id].lang_pred) for r in rows if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_texts_without_letters_are_undetermined(spark, docs, empty):
    got = language_id.languages(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    bare = sum(not any(c.isalpha() for c in r.text or "") for r in docs.select("text").collect())
    assert bare == sum(r.lang_pred == "und" for r in got) == sum(r.score == 0 for r in got) > 3
    assert {r.lang_pred for r in language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.languages(empty).collect() == []


def test_exponents_meet_their_targets():
    tokens = [100.0, 10.0, 1.0, 0.0]
    a = mixing.solve_exponent(tokens, max_repeat=4.0)
    each = [w / t for w, t in zip(mixing.shares(tokens, a), tokens) if t]
    assert max(each) / min(each) == pytest.approx(4.0)
    a = mixing.solve_exponent(tokens, target_entropy=0.9)
    assert mixing.entropy(mixing.shares(tokens, a)) == pytest.approx(0.9)
    assert mixing.solve_exponent(tokens, target_entropy=5.0) == 0.0
    assert mixing.solve_exponent([5.0], max_repeat=2.0) == 1.0


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("budget", [None, 20_000])
def test_mix_meets_budgets(spark, docs, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 2_000)
    rows = mixing.mix(docs, max_repeat=2.0, budget=budget).collect()
    again = mixing.mix(docs, max_repeat=2.0, budget=budget).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    given = docs.select("doc_id", "text", "source").collect()
    totals = Counter()
    for r in given:
        totals[r.source or ""] += count(r.text)
    budgets = mixing.source_budgets(totals, max_repeat=2.0, budget=budget)
    taken, longest = Counter(), defaultdict(int)
    for r in rows:
        taken[r.source or ""] += r.n_tokens
    copies = Counter((r.source or "", r.text) for r in given)
    for (source, text), n in copies.items():
        longest[source] = max(longest[source], n * count(text))
    for source, (_, want) in budgets.items():
        assert want <= taken[source] < want + max(1, longest[source])
    if budget is None:
        assert Counter((r.doc_id, r.text) for r in rows if r.epoch == 0) == Counter((r.doc_id, r.text) for r in given)
        assert max(math.ceil(b / totals[s]) for s, (_, b) in budgets.items() if totals[s]) <= 3


def test_mix_takes_the_blocks_and_documents_that_a_plain_version_takes(spark, docs, monkeypatch):
    """Budgets, permutations and the cut of the last epoch in plain Python, on Spark's hashes; clashing columns come back."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 2_000)
    seed, clash = 5, {"weight": F.lit("w"), "Place": F.lit(1), "_mix_key": F.col("doc_id"), "_source": F.lit("mine"), "_key": F.lit("k")}
    odd = docs.withColumns(clash)
    got = mixing.mix(odd, max_repeat=2.0, budget=60_000, seed=seed).collect()
    assert {(r["_source"], r["_key"]) for r in got} == {("mine", "k")} and all(r["_mix_key"] == r["doc_id"] for r in got)
    hashed = docs.select(
        "doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("doc_id", "text").alias("key")
    ).withColumn("n_tokens", mixing.words(F.col("text")))
    totals = Counter()
    for r in hashed.collect():
        totals[r["source"]] += r["n_tokens"]
    budgets = mixing.source_budgets(totals, max_repeat=2.0, budget=60_000)
    plan = [(s, b // max(1, totals[s]), b % max(1, totals[s]), max(1, totals[s] // 2_000)) for s, (_, b) in budgets.items()]
    sources = spark.createDataFrame(plan, "source string, epochs long, rest long, blocks long")
    block = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks"))
    rows = hashed.join(sources, "source").withColumn("block", block).withColumn(
        "place", F.xxhash64("source", "block", F.lit(seed), "epochs")
    ).withColumn("order", F.xxhash64("key", F.lit(seed), "epochs")).collect()
    want = Counter()
    for source, epochs, rest, _ in plan:
        mine = [r for r in rows if r["source"] == source]
        at, taken = 0, set()
        for _, group in sorted({(r["place"], r["block"]) for r in mine if r["n_tokens"]}):
            inside = Counter()
            for r in mine:
                if r["block"] == group and r["n_tokens"]:
                    inside[r["order"], r["key"]] += r["n_tokens"]
            fits, place = at + inside.total() <= rest, at
            for (_, key), n in sorted(inside.items()):
                if at < rest and (fits or place < rest):
                    taken.add(key)
                place += n
            at += inside.total()
        for r in mine:
            want[r["doc_id"], r["text"]] += 1 if not r["n_tokens"] else epochs + (r["key"] in taken)
    have = Counter((r["doc_id"], r["text"]) for r in got)
    assert have == +want
    # An epoch is one permutation: a block has one place in it, and other epochs have other orders.
    places = {}
    for r in got:
        assert places.setdefault((r["source"], r["block"], r["epoch"]), r["place"]) == r["place"]
    assert len(set(places.values())) == len(places)


def test_mix_of_nothing(spark, empty, docs):
    assert mixing.mix(empty).collect() == []
    blank = docs.where("text IS NULL OR trim(text) = ''")
    assert mixing.mix(blank).count() == blank.count()


def test_licences_and_notices(spark):
    mit = license_scan.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit),
        (2, mit.upper().replace("COPYRIGHT HOLDERS", "Copyright owners").replace("\n", "  \r\n")),
        (3, mit + " More."),
        (4, "prose\nLicenced under the Apache Licence, version 2.0\nmore\nReleased under the MIT License."),
        (5, None),
        (6, ""),
        (1, "Copyright (c) 2020 Somebody\n\n" + mit),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("license", F.lit("x"))
    got = sorted((r.doc_id, r.license or "", r.notices) for r in license_scan.license_scan(df).collect())
    assert got == [(1, "MIT", ""), (1, "MIT", ""), (2, "MIT", ""), (3, "", ""), (4, "", "Apache-2.0,MIT"), (5, "", ""), (6, "", "")]
    assert license_scan.license_scan(df.limit(0)).collect() == []


def wrapped(text, width):
    return "\n".join(textwrap.fill(x, width, break_on_hyphens=False) for x in text.split("\n"))


def test_licences_are_found_however_they_are_wrapped(spark):
    joined = {k: " ".join(v.split()) for k, v in license_scan.TEXTS.items()}
    holder = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n"
    forms = [(k, holder + wrapped(v, w)) for k, v in joined.items() for w in (10**6, 41, 66, 79)]
    usual = joined["MIT"].replace("AUTHORS OR COPYRIGHT", "AUTHORS\nOR COPYRIGHT").replace("OR COPYRIGHT", "OR\nCOPYRIGHT")
    rows = [(i, k, t) for i, (k, t) in enumerate([*forms, ("MIT", usual), ("MIT", joined["MIT"])])]
    df = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = license_scan.license_scan(df).collect()
    assert {r.doc_id: r.license for r in got} == {i: k for i, k, _ in rows}


def test_only_holder_lines_are_taken_off(spark):
    prose = ["copyright law applies", "(c) You must retain it", "All rights reserved by law stay", "copyright holders agree"]
    holders = ["Copyright 2020 A", "# Copyright (C) B", "// © 2021 C", "(c) 1999 D", "Copyright by E", "All rights reserved.", "Copyright [yyyy] [name]"]
    rows = [(i, f"one\n{x}\ntwo") for i, x in enumerate([*prose, *holders])]
    df = spark.createDataFrame(rows, "i long, text string").select("i", license_scan.canonical(F.col("text")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert all((got[i] != "one two") == (i < len(prose)) for i in got)


def test_titles_and_holders_do_not_matter(spark):
    rows = [(k, f"# {title}\n\nCopyright (c) 2020 A\n\n{license_scan.TEXTS[k]}") for k, titles in license_scan.TITLES.items() for title in titles]
    bsd = license_scan.TEXTS["BSD-3-Clause"].replace("3. Neither", "  * Neither").replace("the copyright holder nor", "Foo Inc. nor")
    rows += [("BSD-3-Clause", bsd.replace("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY FOO INC."))]
    rows += [("MIT", license_scan.TEXTS["MIT"].replace('"', "\u201d")), ("", "MIT License"), ("", "The BSD License\n" + bsd + " More.")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, want string, text string")
    got = {r.doc_id: r.license or "" for r in license_scan.license_scan(df).collect()}
    assert got == {i: k for i, (k, _) in enumerate(rows)}


STANDARD = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/MPL-2.0").exists(), reason="no standard texts on this system")
def test_long_texts_are_known(spark):
    files = {k: Path("/usr/share/common-licenses", v).read_text() for k, v in STANDARD.items()}
    rows = [(k, t) for k, t in files.items()] + [("Apache-2.0", files["Apache-2.0"].split("      APPENDIX")[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, want string, text string")
    assert {r.doc_id: r.license for r in license_scan.license_scan(df).collect()} == {i: k for i, (k, _) in enumerate(rows)}


def test_lines_are_filtered_by_the_given_notices(spark):
    notices = {"X": "Public domain work.", "Y": "Version 3"}
    df = spark.createDataFrame([(1, "a\n-- " + "-" * 400 + " PUBLIC domain: work\nver. 3"), (2, "public work")], "doc_id long, text string")
    assert {r.doc_id: r.notices for r in license_scan.license_scan(df, notices=notices).collect()} == {1: "X,Y", 2: ""}


def test_registered_mixing_and_licences(spark, folder, docs):
    assert queries.op3_license_scan(spark, folder).count() == docs.count()
    assert queries.op6_mixing(spark, folder).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
