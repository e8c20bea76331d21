"""The pipeline's stages: what each may drop or change, and the whole run."""

from __future__ import annotations

import shutil
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.llm.test_dedup import check_dropped
from tidemark.llm.common import saved


@pytest.fixture(scope="module")
def stages(spark, folder):
    shutil.copy(f"{SMALL}/labels.parquet", f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], folder), name))
    return out


def bag(df):
    return Counter(map(str, df.collect()))


def test_stages_keep_the_columns(stages):
    assert all(s.schema == stages[0].schema for s in stages[1:5])


def test_toxicity_only_drops(stages):
    assert not bag(stages[1]) - bag(stages[0]) and 0 < stages[1].count() < stages[0].count()


def test_one_of_each_class_stays(stages):
    check_dropped(*([tuple(r) for r in stages[i].select("doc_id", "text").collect()] for i in (1, 2)))


def test_secrets_are_cut_and_nothing_else(stages):
    before = {(r.doc_id, r.text) for r in stages[2].collect()}
    for r in stages[3].collect():
        assert (r.doc_id, r.text) in before or "[SECRET]" in r.text and r.n_chars == len(r.text)
    assert stages[2].count() == stages[3].count()
    assert not any("Zx9+Qw8" in (r.text or "") for r in stages[3].collect())


def test_mixing_repeats_but_keeps_all(stages):
    assert not bag(stages[3]) - bag(stages[4]) and set(bag(stages[3])) == set(bag(stages[4]))


def test_sequences_are_gapless(stages):
    bins = defaultdict(list)
    for r in stages[5].collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert stages[5].select("doc_id").distinct().count() == stages[4].select("doc_id").distinct().count()


def test_registered_run(spark):
    assert entry.queries()["pipeline"](spark, SMALL).count() > 100


def test_empty_tables(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
