"""Learned scores, calibration and packing against slow versions."""

import random
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import packing, quality, toxicity
from cairn.llm.decontaminate import words_of
from cairn.llm.subwords import ngrams
from tests.llm.test_contracts import corpus


def slow_buckets(word, sizes, buckets):
    prime, mix, top = 1099511628211, 0x9E3779B97F4A7C15, 1 << 64
    marked, found = b"<" + word + b">", []
    for n in sizes:
        for k in range(len(marked) - n + 1):
            h = 0
            for c in marked[k : k + n]:
                h = (h * prime + c) % top
            found.append((h + n) % top)
    found.append(sum((c + 1) * pow(mix, k % 61 + 1, top) for k, c in enumerate(marked)) % top)
    return sorted((h * mix % top >> 40) % buckets for h in found)


def test_ngram_buckets():
    words = [b"a", "größe".encode(), b"internationalisation", b"xy", b"a" * 200]
    owner, bucket = ngrams(words, (3, 4, 5, 6, 7), 1 << 19)
    for k, w in enumerate(words):
        assert sorted(bucket[owner == k].tolist()) == slow_buckets(w, (3, 4, 5, 6, 7), 1 << 19)


@cache
def _word_grams(word):
    return tuple(slow_buckets(word, toxicity.SIZES, toxicity.BUCKETS))


def slow_toxicity(model, text):
    """The score of a text by its definition: the most toxic span's mean over words of the mean of their learned n-grams."""
    if isinstance(text, str):
        text = text.encode()
    shares = []
    for w in words_of(text):
        known = [b for b in _word_grams(w) if model.learned[b]]
        shares.append(sum(float(model.weight[b]) for b in known) / max(1, len(known)))
    spans = [sum(shares[k : k + model.span]) / model.span for k in range(len(shares) - model.span + 1)] if len(shares) > model.span else [sum(shares) / len(shares)] if shares else [0.0]
    return 1 / (1 + np.exp(-(model.bias + max(spans))))


def test_toxicity_is_the_most_toxic_span(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("mor", "tel", "san", "ruk", "ven") for b in ("ado", "ine", "ol", "ug", "ash")]
    text = lambda n, *more: " ".join(rng.sample([*rng.choices(words, k=n), *more], n + len(more)))
    rows = [(k, text(rng.randint(0, 60), *(["wretchling"] if k % 3 == 0 else []))) for k in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (None, "a wretchlings b"), (901, ""), (902, text(30_000)), (903, text(30_000, "wretchling")), *rows[:3]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1 - min(1, k % 3)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels, F.lit(True))
    held = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.toxicity_scores(docs, model).collect()
    assert len(found) == 408
    for r in found:
        assert abs(r.score - slow_toxicity(model, held[r.doc_id])) < 1e-5 and r.predicted == (r.score >= 0.3)
    by_id = {r.doc_id: r.predicted for r in found}
    assert by_id[903] == by_id[None] == 1 and by_id[902] == by_id[900] == by_id[901] == 0


def slow_isotonic(positive, total):
    n = len(total)
    mean = lambda a, b: positive[a : b + 1].sum() / total[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)])


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_is_the_best_rising_fit(seed):
    rng = np.random.default_rng(seed)
    total = rng.integers(1, 6, 25).astype(float)
    positive = np.minimum(total, rng.integers(0, 6, 25)).astype(float)
    assert np.allclose(quality.isotonic(positive, total), slow_isotonic(positive, total))


def test_quality_is_a_ridge_on_random_features(spark):
    texts = [(i, t) for i, t in corpus() if i is not None and i not in (20,)] + [(1000 + k, ("good words in here, " if k % 2 else "#### 1 ") * (k % 17 + 1)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2 if k % 9 else (i + 1) % 2) for k, (i, _) in enumerate(texts)] + [(5, None), (77_777, 1)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.quality_model(stats, labels, F.col("doc_id") % 7 != 3, features=40)
    kept_out = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    rows = stats.join(labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id").where("doc_id % 7 <> 3").select("stats", "y", kept_out.alias("out")).collect()
    x, y, out = np.array([r.stats for r in rows]), np.array([r.y for r in rows], float), np.array([r.out for r in rows])
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.concatenate([np.sqrt(2 / 40) * np.cos(z @ model.omega + model.phase), z, np.ones((len(z), 1))], 1)
    penalty = np.full(z.shape[1], 1.0)
    penalty[-1] = 1e-6
    weight = np.linalg.solve(z[~out].T @ z[~out] + np.diag(penalty), z[~out].T @ y[~out])
    assert np.allclose(model.weight, weight, atol=1e-6)
    raw = z[out] @ weight
    bins = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    some = np.unique(bins)
    total, positive = (np.array([f(bins == b) for b in some], float) for f in (lambda m: m.sum(), lambda m: y[out][m].sum()))
    assert np.allclose(model.calibrated, slow_isotonic(positive, total), atol=1e-9)
    # Gaussian kernel: the random features' products approach it.
    wide = quality.quality_model(stats, labels, F.lit(True), features=6000)
    a, b = (wide.features(x[k : k + 1])[0, :6000] for k in (0, 1))
    u, v = (np.clip((x[k] - wide.mean) / wide.scale, -6, 6) for k in (0, 1))
    assert abs(a @ b - np.exp(-0.12 * ((u - v) ** 2).sum())) < 0.05


def optimum(pieces, room):
    """The fewest sequences, by trying all."""
    best = len(pieces)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + pieces[k] <= room:
                place(k + 1, [*bins[:i], bins[i] + pieces[k], *bins[i + 1 :]])
        place(k + 1, [*bins, pieces[k]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


def test_packing_comes_near_the_optimum():
    rng = random.Random(8)
    exact = 0
    for _ in range(60):
        pieces = [rng.choice([rng.randint(1, 100), rng.randint(20, 60)]) for _ in range(rng.randint(1, 10))]
        plan, least = packing.Plan(dict(Counter(pieces)), 100), optimum(pieces, 100)
        assert least <= plan.sequences <= least + 1
        exact += plan.sequences == least
    assert exact >= 55


def test_dominance_keeps_the_optimum():
    rng = random.Random(9)
    fixed = 0
    for _ in range(60):
        pieces = [rng.choice([rng.randint(51, 100), rng.randint(10, 50)]) for _ in range(rng.randint(2, 9))]
        plan = packing.Plan(dict(Counter(pieces)), 100)
        fixed += plan.fixed > 0
        if plan.fixed == len(pieces):
            assert plan.sequences == optimum(pieces, 100)
    assert fixed > 30
