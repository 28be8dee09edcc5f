"""Stages of a small input are few files, however many partitions a shuffle has."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

import pytest

from hostpulse.llm import components, dartminhash, decontaminate, quality, secrets
from hostpulse.llm.common import tasks_for

RNG = random.Random(5)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(n))


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 61 partitions that Spark does not put together by itself."""
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """The files of every stage written, by its name."""
    found: dict[str, int] = {}

    def spy(df, name, real=dartminhash.staged):
        out = real(df, name)
        paths = [urlparse(p).path for p in out.inputFiles()]
        found[name] = max(found.get(name, 0), len(paths))
        for folder in {os.path.dirname(p) for p in paths}:
            assert not os.path.exists(f"{folder}/_SUCCESS")
        return out

    for module in (components, dartminhash, decontaminate, secrets):
        monkeypatch.setattr(module, "staged", spy)
    return found


def test_few_files_in_every_stage(many_partitions, files, tmp_path):
    spark = many_partitions
    item = prose(30)
    texts = [prose(80) for _ in range(300)]
    texts += [t.replace(t.split()[0], "other", 1) for t in texts[:150]]
    texts += [prose(40) + " " + " ".join(item.split()[5:20]) for _ in range(60)]
    texts += [prose(20) + f" password={''.join(RNG.choice('abcdef') for _ in range(14))} " + prose(20) for _ in range(120)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    most = tasks_for(docs)
    assert most == spark.sparkContext.defaultParallelism < 61
    kept = dartminhash.keep_one(docs)
    clean = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    masked = secrets.mask_secrets(docs)
    assert {"buckets", "nodes", "links", "members", "kept-ids", "benchmark-hits", "leaks", "secret-spans"} <= set(files)
    assert {name: n for name, n in files.items() if n > most} == {}
    assert [kept.rdd.getNumPartitions() <= most, clean.count(), masked.where("text LIKE '%password=%'").count()] == [True, 570, 0]
    assert kept.count() == 480


def test_fitting_sorts_few_partitions(many_partitions, tmp_path):
    spark = many_partitions
    rows = [(i, prose(20), i % 2) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, quality int").write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    group = "fit"
    spark.sparkContext.setJobGroup(group, group)
    try:
        quality.fit_quality(table.select("doc_id", "text"), table.select("doc_id", "quality"))
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 371 tasks where every shuffle is read by 61
    assert sum(s.numTasks for s in stages if s) < 5 * 61
