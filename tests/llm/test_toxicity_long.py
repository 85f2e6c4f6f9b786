"""Long labelled texts shape the model like short ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import toxicity
from cairn.llm.decontaminate import words_of


def test_toxic_words_of_long_texts_are_learned(spark):
    rng = random.Random(4)
    words = [f"plain{k}" for k in range(200)]
    bad = ["wretchling", "wretchlings", "wretchlinger"]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(60)] + [" ".join(rng.choices(words, k=5000)) for _ in range(8)]
    toxic = [" ".join(rng.choice(bad) if k % 40 == 7 else w for k, w in enumerate(rng.choices(words, k=5000))) for _ in range(20)]
    assert min(map(len, toxic)) > 20_000
    rows = [(k, t, int(k >= len(clean))) for k, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels, F.lit(True))
    new = spark.createDataFrame([(1, "plain1 plain2 wretchling plain3"), (2, "plain4 plain5 plain6 plain7")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity_scores(new, model).collect()} == {1: 1, 2: 0}


def test_no_word_of_a_sampled_text_is_lost(spark):
    texts = ["a b c " * 9000, "x", "", None, "x", "a b c " * 9000]
    sample = spark.createDataFrame([(k // 2, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, label int").select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    vocabulary, docs = toxicity.numbered(sample)
    assert sorted(([vocabulary[i] for i in ids], y) for ids, y in docs) == sorted((words_of(t.encode()), k % 2) for k, t in enumerate(texts) if t)
    assert all(ids.dtype == np.int32 for ids, _ in docs)
