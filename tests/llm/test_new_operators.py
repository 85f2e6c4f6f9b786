"""Periodic runs, hard negatives and sentencepiece against their definitions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import hard_negatives, periodic_runs, pieces
from cairn.llm.queries import PIECES, queries, vocabulary_path
from tests.llm.test_contracts import SMALL, corpus, multiset


def slow_runs(words, least, exponent):
    """Every maximal stretch of every period, the smallest period of each."""
    found, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k > i and k - i + p >= max(least, exponent * p):
                found.setdefault((i, k - i + p), p)
            i = k + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic_text(rng, letters, n):
    """Words with runs of many periods, some within runs of longer ones, some seen before."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3:
            out += rng.choices(letters, k=rng.randint(1, 8))
        elif kind < 0.8:
            base = rng.choices(letters, k=rng.choice([1, 1, 2, 3, 4, 7, 11]))
            out += (base * rng.randint(2, 7))[: rng.randint(2, 60)]
        elif out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randint(1, 80)]
    return out[:n]


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (3, 3), (5, 2), (9, 4), (12, 5)])
def test_runs_are_all_maximal_stretches(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(40):
        documents = [periodic_text(rng, [b"a", b"b", b"c"][: rng.randint(1, 3)], rng.randint(0, 250)) for _ in range(rng.randint(1, 6))]
        assert periodic_runs.runs_of(documents, least, exponent) == [slow_runs(d, least, exponent) for d in documents]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=60), max_size=4))
def test_runs_of_any_words(documents):
    for least, exponent in ((6, 4), (2, 2)):
        assert periodic_runs.runs_of(documents, least, exponent) == [slow_runs(d, least, exponent) for d in documents]


def test_runs_of_long_texts_sorted_apart(monkeypatch):
    rng = random.Random(9)
    documents = [periodic_text(rng, [b"a", b"b"], 1500), [b"z"] * 3000, periodic_text(rng, [b"a", b"b", b"c"], 900), [b"x", b"y"] * 700]
    want = [slow_runs(d, 6, 4) for d in documents]
    assert periodic_runs.runs_of(documents, 6, 4) == want
    monkeypatch.setattr(periodic_runs, "TOGETHER", 500)
    monkeypatch.setattr(periodic_runs, "PAIRS", 100)
    assert periodic_runs.runs_of(documents, 6, 4) == want


def slow_figures(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words, 6, 4)
    lost = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in lost))


def test_periodic_runs_query(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in corpus()] + [(1000 + k, " ".join(w.decode() for w in periodic_text(rng, [b"a", b"b", "é".encode()], rng.randint(0, 300)))) for k in range(60)]
    rows += [(7, "a\x0bb\x1cc a b   " * 9), (1060, "x " * 5000), (1060, "x " * 5000), (2000, " \t\n "), (2010, "one")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    found = periodic_runs.periodic_runs(periodic_runs.planted(docs))
    assert multiset(periodic_runs.figures(found)) == Counter(slow_figures(i, t) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    plain = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs.where("doc_id = 1060").limit(1)).collect()}[1060]
    assert (plain.n_words, [tuple(r) for r in plain.runs], plain.collapsed) == (5000, [(0, 5000, 1)], "x")


def test_periodic_runs_of_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert multiset(queries()["op11_periodic_runs"](spark, SMALL)) == Counter(slow_figures(i, t) for i, t in docs)


def slow_negatives(rows, positives=5, negatives=5, low=80, high=100):
    kept = []
    for i, label, v in rows:
        if None not in (i, label, v) and len(v) and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(float(np.float32(x)) * 256)) for x in v]
            if sum(x * x for x in w) < 1 << 62:
                kept.append((i, label, w))
    out = Counter()
    for i, label, v in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m == label) for j, m, w in kept if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            for rank, (t, k, _) in enumerate(fits[:negatives], 1):
                out[(i, j, rank, k, -s, -t)] += 1
    return out


def vectors_with_ties():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12)) / 4
    rows = [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + rng.normal(size=12) * 0.08).tolist()) for i in range(900)]
    hot = rows[5][2]
    rows += [(2000 + k, k % 3, hot) for k in range(400)] + [(3000, 1, hot), (3000, 1, hot), (3001, 2, hot)]
    odd = [[0.0] * 12, [1.0] * 5, [-0.5] * 5, [0.25] * 5, [], [None] + [0.1] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, None, [1e20] * 12, [3e7] + [0.0] * 11]
    rows += [(4000 + 50 * k, k % 2, v) for k, v in enumerate(odd)] + [(4001 + 50 * k, 1 - k % 2, v) for k, v in enumerate(odd)]
    return rows + [(None, 1, hot), (5000, None, hot), (5100, 9, rows[7][2]), (-100, 0, rows[8][2])]


def test_hard_negatives_are_those_of_all_pairs(spark):
    rows = vectors_with_ties()
    df = spark.createDataFrame([(i, n, v, 1, 2.0) for i, n, v in rows], "vec_id long, label int, embedding array<float>, score int, rank double").repartition(5)
    for block in (4096, 4):
        assert multiset(hard_negatives.hard_negatives(df, block=block)) == slow_negatives(rows)
    got = hard_negatives.hard_negatives(df, positives=3, negatives=7, low=10, high=90)
    assert multiset(got) == slow_negatives(rows, 3, 7, 10, 90)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_bounds_hold_every_exact_score():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 15)) * 60).astype(np.int64)
    books = hard_negatives.fitted(x[:300].astype(float))
    code, rest = hard_negatives.coded(x.astype(float), books)
    block = hard_negatives.Block(np.arange(50), np.arange(50), np.zeros(50), x[:50], books)
    low, high = block.bounds(slice(0, 50), code, rest, np.sqrt((x.astype(float) ** 2).sum(1)))
    score = x[:50] @ x.T
    assert (low <= score).all() and (score <= high).all() and (high - low).mean() < 0.1 * (score.max() - score.min())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary_path(PIECES))


HARD = ["", " ", "  ", "a  b", "  a ", "a▁b", "▁", "▁▁x▁", "\n", "a\nb", "\na", "a \n b", " \n\n ", "ﬁ Ａ", "\t x\r\n", "a\x00b", "<s> </s> <unk> <0x0A>", "a　b", "é é", "﻿x", "漢字かな 한글 нет 😀", "x" * 3000, "word " * 3000, "don't. a,b", "\x85  "]


def test_chunks_give_the_ids_of_whole_texts(library):
    table = pieces.chunks(vocabulary_path(PIECES))
    assert table.split is not None
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choices([" ", " ", "\n", "▁", "a", "b", "the", "ing", "é", "\t", "漢", "😀", ".", "<0x0A>"], k=rng.randint(0, 40))) for _ in range(3000)]
    want = [library.encode(t) for t in texts]
    got = list(table.encode([t.encode() for t in texts]))
    assert [a.decode() for a, _ in got] == [",".join(map(str, ids)) for ids in want]
    assert [b.decode() for _, b in got] == [library.decode(ids) for ids in want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_chunks_of_any_text(text):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=vocabulary_path(PIECES))
    ids = library.encode(text)
    assert list(pieces.chunks(vocabulary_path(PIECES)).encode([text.encode()])) == [(",".join(map(str, ids)).encode(), library.decode(ids).encode())]


def test_a_full_table_forgets_and_a_model_may_take_whole_texts(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROOM", 10)
    monkeypatch.setattr(pieces, "TABLE_WORD", 3)
    texts = [f"w{k} again and▁more{k % 7}\nline".encode() for k in range(100)] * 2
    table = pieces.chunks(vocabulary_path(PIECES))
    whole = pieces.Chunks(library, None, "▁")
    for a in range(0, 200, 7):
        assert list(table.encode(texts[a : a + 7])) == list(whole.encode(texts[a : a + 7]))
    assert len(table.ids) <= 60


def test_encoded_documents(spark, library):
    rows = corpus() + [(500 + k, t) for k, t in enumerate(HARD)]
    docs = spark.createDataFrame([(i, t, 3, "z") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = pieces.encoded(docs, vocabulary_path(PIECES))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows)
    assert pieces.encoded(docs.limit(0), vocabulary_path(PIECES)).count() == 0
    for r in got.select("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256").collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())


def test_encoded_tables(spark, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert multiset(queries()["op13_sentencepiece"](spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_hard_negatives_query_matches_its_sql(spark, same_rows):
    from cairn.llm.queries import oracle_sql

    assert same_rows(queries()["op12_hard_negatives"], oracle_sql()["op12_hard_negatives"]) > 0
