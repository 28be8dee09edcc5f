"""The corpus pipeline on a small table whose right result is worked out row by row."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from hostpulse.llm.queries import TOKENIZER

RNG = random.Random(21)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(n))


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_pipeline(spark, tmp_path):
    texts = {i: prose(120) for i in range(150)}
    texts |= {200 + i: " ".join(RNG.choice(["CLICK", "$$$", "99", "WIN!!"]) + str(RNG.randrange(999)) for _ in range(120)) for i in range(150)}
    labels = [(i, int(i < 200), 0) for i in texts]
    item = prose(30)
    texts[400] = texts[0]
    texts[401] = re.sub(r"^\S+", "other", texts[1])
    texts[402] = prose(60) + " " + " ".join(item.split()[5:20]) + " " + prose(60)
    texts[403] = prose(60) + " password=abcdefghijklmnop " + prose(60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = {i: t for i, t in texts.items() if not 200 <= i < 400}
    for i in sorted(want):
        bags = {k: shingles(want[k]) for k in want if k < i}
        own = shingles(want[i])
        if any(len(own & bag) >= 0.8 * len(own | bag) for bag in bags.values()):
            del want[i]
    passages = {tuple(item.split()[i : i + 13]) for i in range(18)}
    for i in list(want):
        words = want[i].split()
        if any(tuple(words[k : k + 13]) in passages for k in range(len(words) - 12)):
            del want[i]
    want = {i: re.sub(r"password=[a-z]{12,}", "[secret]", t) for i, t in want.items()}
    assert sorted(want) == [*range(150), 403]

    library = Tokenizer.from_file(TOKENIZER)
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted(want)
    for i, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == ids and rows[i]["n_tokens"] == len(ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_encoding_and_decoding_take_turns(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    coded = corpus_pipeline.encode(spark, docs, sf_dir)
    # one worker for a task, not one that encodes and one that decodes
    assert coded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in coded.collect()} == {1: True, 2: False}
