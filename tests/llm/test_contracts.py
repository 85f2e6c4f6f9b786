"""The ten operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import context_tree, decontaminate, embeddings, language_id, licences, line_dedup, packing, quality, simhash, toxicity
from cairn.llm.common import fold
from cairn.llm.components import components, local_labels, tree_edges
from cairn.llm.queries import oracle_sql, queries, vocabulary_path
from cairn.llm.subwords import WordTable

SMALL = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "theta", "iota", "kappa", "über", "mu"]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(n))
    out = [(1, None), (2, ""), (3, "   \t "), (4, "x"), (5, text(3)), (6, text(400)), (7, "repeated line here\nshort\n\n" + text(1)), (8, "  REPEATED line here \nshort\n" + text(1)), (9, "!!! ???"), (None, text(2) + "\nrepeated line here")]
    base = text(12)
    out += [(20, base), (21, base), (22, base.replace("alpha", "omega", 1)), (23, text(12)), (20, base), (24, "a\x0bb\x1cc <|endoftext|> It's 12 o'clock, don't.")]
    return out + [(100 + k, text(rng.randint(1, 6))) for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), 1, "a", 0) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, first string, n_lines int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def test_line_dedup(docs, empty):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in corpus():
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    want = Counter()
    for i, t in corpus():
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        want[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    for bits in (1 << 17, 1 << 27, None):
        assert multiset(line_dedup.line_dedup(docs, with_text=False, filter_bits=bits)) == want
    whole = line_dedup.line_dedup(docs)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "first", "n_lines", "n_dropped", "kept_sha256"]
    assert multiset(whole.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))) == want
    assert whole.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert line_dedup.line_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = dict(corpus())
    items = [(1, " ".join(words(texts[6])[40:60])), (2, "x"), (10, texts[20]), (3, None), (4, "..."), (5, "never seen words in here at all or anywhere else ever"), (10, texts[20]), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in corpus():
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x) if item is not None else []
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(item)
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))] += 1
    for block in (10, 1_000_000):
        assert multiset(decontaminate.figures(decontaminate.contamination(docs, bench, block_words=block))) == want
    named = bench.withColumn("item_id", F.concat(F.lit("item-"), "item_id"))
    by_name = decontaminate.contamination(docs, named, block_words=25).select("doc_id", "n_words", F.explode_outer("items").alias("item"))
    assert {r.item for r in by_name.where("item is not null").distinct().collect()} == {"item-1", "item-2", "item-10"}
    dirty = {k[0] for k in want if k[-1]}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {i for i, _ in corpus()} - dirty
    cut = decontaminate.decontaminate(docs, bench, mode="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("doc_id = 4").first().text == ""
    assert decontaminate.figures(decontaminate.contamination(empty, bench)).count() == 0
    assert not decontaminate.figures(decontaminate.contamination(docs, bench.limit(0))).where("contaminated").count()


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[a : a + k]), 42) for a in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    rows = [(i, slow_fingerprint(t)) for i, t in corpus()]
    group = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            for j, g in rows:
                if None not in (i, j) and (f ^ g).bit_count() <= 4 and group[j] < group[i]:
                    group[i], changed = group[j], True
    want = Counter((i, f"{f:016x}", group.get(i)) for i, f in rows)
    assert multiset(simhash.near_duplicates(docs)) == want
    assert multiset(simhash.near_duplicates(docs, tile=2)) == want
    assert multiset(simhash.near_duplicates(docs, blocks=6)) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i is None or group[i] == i}
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_point_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.concatenate([centre, *[centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]])
    fp = np.unique(fp)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    a, b = simhash.close_pairs(fp, 4)
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == {frozenset(p) for p in zip(i.tolist(), j.tolist())}


def test_blocks_grow_with_the_classes():
    assert [simhash.blocks_for(n, 4, 1024) for n in (0, 1 << 22, 1 << 28, 1 << 36, 1 << 42)] == [5, 5, 6, 7, 8]
    assert [len(simhash.shard_columns(b, 4)) for b in (5, 6, 7, 8)] == [5, 15, 35, 70]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)] + [(500, 500)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {(v, find(v)) for a, b in pairs if a != b for v in (a, b)}
    assert {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_edges_span_components():
    label = np.array([0, 0, 2, 0, 2, 5])
    a, b = tree_edges(label, np.array([10, 11, 12, 13, 14, 15]))
    assert set(zip(a.tolist(), b.tolist())) == {(10, 11), (10, 13), (12, 14)}
    assert (local_labels(4, np.array([2, 3]), np.array([3, 1])) == [0, 1, 1, 1]).all()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for i, x in corpus():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[s : s + 256], "<u4")
            want[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    out = packing.pack(docs, vocabulary_path(), 256)
    rows = out.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) <= -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack(empty, vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 20), rng.randint(1, 100)]) for _ in range(rng.choice([5, 60, 400])))
    plan = packing.Plan(dict(counts), 100)
    held, placed = defaultdict(list), Counter()
    for length, first, after, sequence, each, offset in plan.slots:
        for k in range(first, after):
            held[sequence + (k - first) // each].append((offset + (k - first) % each * length, length))
            placed[length] += 1
    assert placed == counts and len(held) == plan.sequences
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1]) and sum(n for _, n in parts) <= 100
    assert plan.sequences <= 1.1 * -(-sum(k * n for k, n in counts.items()) // 100) + 1


def test_dominance_fixes_exact_fits():
    plan = packing.Plan({60: 3, 40: 3, 100: 2, 70: 1, 20: 1}, 100)
    assert plan.fixed == 6 and plan.sequences == 6


def test_plain_words_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    texts = ["Die Größe, façade naïve. ÉCOLE ǆ ﬁ é ß ſ", "don't we're a.b, c. d.\ne,f  x y", "<|STARTOFTEXT|> <|startoftext|>"]
    for x, got in zip(texts, packing.token_bytes([x.encode() for x in texts], vocabulary_path())):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_any_vocabulary_gives_its_own_ids():
    from tokenizers import Tokenizer

    folder = os.path.dirname(vocabulary_path())
    texts = [*packing.PROBES, "The  quick brown\nfox, it's 12.5 <|endoftext|> OK. naïve Größe 漢字", *[t for _, t in corpus()[:12]]]
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".json")):
        try:
            tokenizer = Tokenizer.from_file(f"{folder}/{name}")
        except Exception:  # noqa: BLE001  (another kind of file)
            continue
        for x, got in zip(texts, packing.token_bytes([None if x is None else x.encode() for x in texts], f"{folder}/{name}")):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(x or "", add_special_tokens=False).ids, (name, x)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 20))
    x = np.concatenate([base, base[:5] + rng.normal(scale=0.05, size=(5, 20)), base[:3] * 2, base[:4], base[:4]]).astype(np.float32).tolist()
    rows = list(enumerate(x, 1)) + [(100, None), (101, [0.0] * 20), (102, [float("nan")] * 20), (103, [1.0, None]), (104, []), (105, [1.0, 2.0]), (106, [2.0, 4.0]), (106, [2.0, 4.0]), (107, [float("inf")] + [1.0] * 19), (107, x[0])]
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k in range(len(rows))}
    for k, _, a in good:
        for m, _, b in good:
            if k != m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[k].add(m)
    label = {k: i for k, (i, _) in enumerate(rows)}
    for _ in rows:
        for k in label:
            label[k] = min([label[k], *(label[m] for m in links[k])])
    want = Counter((i, len(links[k]), label[k], i == label[k]) for k, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for tile in (8192, 7):
        assert multiset(embeddings.embedding_duplicates(df, tile=tile)) == want
        assert multiset(embeddings.embedding_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<double>")), tile=tile)) == want
    # All at one place of the first axis: the tile is dealt over several by a hash.
    flat = [(k, [1.0, *np.eye(40)[k].tolist()]) for k in range(40)] + [(50, [1.0, *np.eye(40)[3].tolist()])]
    same = {r.vec_id: r for r in embeddings.embedding_duplicates(spark.createDataFrame(flat, "vec_id long, embedding array<double>"), tile=5).collect()}
    assert len(same) == 41 and same[50].component_id == 3 and sum(r.n_links for r in same.values()) == 2
    assert embeddings.embedding_duplicates(df.limit(0)).count() == 0


def slow_tree(streams, alphabet, depth):
    """Context-tree weighting by its recursive definition: a function from (context, byte) to log10 of the byte's probability."""
    from math import exp, lgamma, log

    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)
    bits = {b: f"{alphabet.word[b]:012b}"[: alphabet.length[alphabet.word[b]]] for b in range(256)}
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for stream in streams:
        whole = b"\n" * depth + stream
        for at in range(depth, len(whole)):
            for d in range(depth + 1):
                context, code = whole[at - d : at], bits[whole[at]]
                for j in range(len(code)):
                    counts[context, code[:j]][int(code[j])] += 1
                    if d:
                        children[context[1:], code[:j]].add(context)

    @cache
    def weighted(context, node):
        own = kt(*counts[context, node])
        if len(context) == depth:
            return own
        return log(0.5) + np.logaddexp(own, sum(weighted(x, node) for x in sorted(children[context, node])))

    def one(context, d, node, last):
        own = context[len(context) - d :]
        zeros, ones = counts.get((own, node), (0, 0))
        if not zeros + ones:
            return last
        p = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return p
        w = exp(log(0.5) + kt(zeros, ones) - weighted(own, node))
        return w * p + (1 - w) * one(context, d + 1, node, p)

    def score(context, byte):
        code = bits[byte]
        p = [one(context, 0, code[:j], 0.5) for j in range(len(code))]
        return sum(np.log10(x if bit == "1" else 1 - x) for x, bit in zip(p, code))

    return score


def byte_histogram(streams):
    return np.bincount(np.frombuffer(b"".join(streams), np.uint8), minlength=256).astype(float)


def test_codewords_are_a_prefix_code_of_every_byte():
    rng = np.random.default_rng(0)
    for histogram in (np.zeros(256), np.arange(256.0) ** 3, 2.0 ** np.arange(256), rng.random(256)):
        alphabet = context_tree.Alphabet.of(histogram)
        lengths = alphabet.length[alphabet.word].astype(int)
        assert lengths.min() >= 1 and lengths.max() <= 12 and len(set(alphabet.word.tolist())) == 256
        assert sum(2.0**-n for n in lengths.tolist()) == 1
        words = sorted(f"{w:012b}"[:n] for w, n in zip(alphabet.word.tolist(), lengths.tolist()))
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    assert context_tree.code_lengths_of([1, 1, 2, 4], 3) == [3, 3, 2, 1] and context_tree.code_lengths_of([1, 1, 2, 40], 2) == [2, 2, 2, 2]


@pytest.mark.parametrize("depth", (0, 2, 3, 6))
def test_context_tree_is_the_weighted_mixture(depth):
    texts = ["abc ab", "abca é", "b", None, "".join(chr(c) for c in range(33, 103)), "нет, да 漢字 ab"]
    streams = [context_tree.stream_of((t or "").encode()) for t in texts]
    alphabet = context_tree.Alphabet.of(byte_histogram(streams[:5]))
    chunk = context_tree.Chunk.of(streams, depth)
    assert len(set(b"".join(streams))) > 70
    grams, text = (np.concatenate(x) for x in zip(*chunk.blocks(alphabet, 7)))
    want = []
    for k, s in enumerate(streams):
        whole = b"\n" * depth + s
        for at in range(depth, len(whole)):
            want.append((k, (int.from_bytes(whole[at - depth : at][::-1]) << 12) | int(alphabet.word[whole[at]])))
    assert want == list(zip(text.tolist(), grams.tolist()))
    known, n = context_tree.chunk_grams(chunk, np.array([0, 0, 0, 0, 0, 1]), alphabet)
    assert n.sum() == sum(map(len, streams[:5])) and set(known.tolist()) == set(grams.tolist())
    trees = [context_tree.Subtrees(known[x], n[x], depth, alphabet) for x in context_tree.pieces(known, depth, 3)]
    sums = [np.concatenate(x) for x in zip(*(t.sums() for t in trees))] if depth else [np.zeros(0, np.int64)] + [np.zeros(0)] * 3
    node, at = np.unique(sums[0], return_inverse=True)
    top = context_tree.Top(node, *(np.bincount(at, x, len(node)) for x in sums[1:]), depth)
    found = np.concatenate([t.logs(top) for t in trees])
    score = slow_tree(streams[:5], alphabet, depth)
    byte_of = {int(w): b for b, w in enumerate(alphabet.word)}
    expected = [score((g >> 12).to_bytes(depth)[::-1], byte_of[g & 4095]) for g in known.tolist()]
    assert np.allclose(found, expected, atol=1e-9)
    for context in (b"\n" * depth, b"abc ab"[:depth], b"zzzzzz"[:depth]):
        assert abs(sum(10 ** score(context, b) for b in range(256)) - 1) < 1e-9


def test_code_lengths(docs, empty):
    held_out = fold("doc_id", 5) == 1
    out = context_tree.code_lengths(docs, held_out, max_hot=5, chunk=500, shard_bytes=100)
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for i, t in corpus():
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in corpus())
    rows = out.collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)
    streams = {k: context_tree.stream_of((t or "").encode()) for k, (_, t) in enumerate(corpus())}
    training = [streams[k] for k, (i, _) in enumerate(corpus()) if not held(i)]
    score = cache(slow_tree(training, context_tree.Alphabet.of(byte_histogram([s[:-1] + b" " for s in training])), 6))
    for k, (i, _) in enumerate(corpus()):
        whole = b"\n" * 6 + streams[k]
        want = sum(score(whole[at - 6 : at], whole[at]) for at in range(6, len(whole)))
        # float32 per byte: on the longest text here, some 25,000 bytes, the sum is right to six digits.
        assert any(r.doc_id == i and abs(r.score - want) < 1e-6 * len(whole) for r in rows), i
    assert context_tree.code_lengths(empty, held_out).count() == 0
    nothing = context_tree.code_lengths(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in nothing)


def test_licences(spark, empty):
    mit = dict(licences.KNOWN)["MIT"]
    texts = [(1, mit), (2, "Copyright (c) 2020 Somebody\n\n" + licences.KNOWN[0][1].upper()), (3, "prose\nReleased  under the mit LICENCE!\nmore\nLicensed under CC BY-NC 4.0."), (4, None), (5, ""), (6, "All about licences"), (3, "again"), (None, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, license string")
    found = multiset(licences.license_scan(df))
    assert found[(2, "MIT", "", 0)] == 1
    assert found[(3, None, "CC-BY-NC-4.0,MIT", 2)] == 2
    assert found[(4, None, "", 0)] == found[(5, None, "", 0)] == found[(6, None, "", 0)] == 1
    assert licences.license_scan(empty).count() == 0
    known = spark.createDataFrame(licences.KNOWN, "license string, text string").select(licences.canonical(F.col("text")).alias("c"), "text", licences.may_match(F.col("text")).alias("may")).collect()
    assert all(r.may and any(a in r.c for a in licences.ANCHORS) for r in known)


def test_whole_licences_in_other_dress(spark):
    whole = {n: t for n, t in reversed(licences.KNOWN) if len(t) > 300}
    folder, files = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, file in files.items():
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}") as f:
                whole[name] = f.read()
    dress = [
        lambda t: t, lambda t: t.upper(), lambda t: "Copyright (c) 2021, Somebody & Sons\n(C) others\n\n" + t + "\n\n", lambda t: t.replace(",", " ; ").replace(".", " ... ").replace("\n", "\n\n  * "),
        lambda t: t.replace("license", "licence").replace("License", "Licence"), lambda t: " ".join(t.replace("authoriz", "authoris").split(" ")) + "\nAll rights reserved.",
    ]
    rows = [(f"{n}|{k}", f(t)) for n, t in whole.items() for k, f in enumerate(dress)] + [(f"other|{n}", t + "\nand one more clause on permission") for n, t in whole.items()]
    ids = {k: (name, t) for k, (name, t) in enumerate(rows)}
    found = {r.doc_id: r.license for r in licences.license_scan(spark.createDataFrame([(k, t) for k, (_, t) in ids.items()], "doc_id long, text string")).collect()}
    for k, (name, _) in ids.items():
        want, variant = name.split("|")
        assert found[k] == (None if want == "other" else want), name
    assert len({n for n, _ in licences.DIGESTS}) == len({d for _, d in licences.DIGESTS}) == 13


def test_language(spark, docs, empty):
    train = {"en": [b"the cat and the dog with the house".split()] * 5, "de": ["der Hund und die Katze mit dem Haus".encode().split()] * 5}
    field = language_id.train(train)
    rows = [(1, "the dog and the house"), (2, "die Katze und der Hund"), (3, None), (4, ""), (5, "12 !!"), (6, "é"), (7, "the dog and " * 5000), (1, "the dog and the house")]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert found[6].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in found.values())
    model = language_id.language_model(docs, fold("doc_id", 4) != 2)
    assert model.languages == ["en"] and language_id.identify(empty, model).count() == 0
    none = language_id.language_model(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_every_language_and_whole_texts_are_learned(spark):
    word = lambda k, n: "".join(chr(97 + (k * 7 + i * (k % 5 + 1)) % 26) for i in range(n))
    rows = [(100 * k + i, "boilerplate in english at the start " * 60 + " ".join(word(k, 3 + (i + j) % 5) for j in range(3000)), f"l{k:03}") for k in range(40) for i in range(2)]
    model = language_id.language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), chains=4, rounds=3)
    assert model.languages == [f"l{k:03}" for k in range(40)]
    (whole,) = language_id.whole_words(iter([pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([1]), pa.array([" ".join(word(i, 3) for i in range(5000)).encode()])], names=["lang", "doc_id", "text"])]))
    words = whole.column(2).to_pylist()[0]
    assert words == [word(i, 3).encode() for i in range(5000)]
    # Chains take spans from the whole text: no tenth of it is without one.
    spelled = [f"{k:04}".encode() for k in range(5000)]
    vocabulary, _, _ = language_id.training_chains({"x": [spelled]}, ["x"], 400, 32, np.random.default_rng(1))
    assert {int(w) * 10 // 5000 for w in vocabulary} == set(range(10))


def slow_posteriors(emit, trans, start):
    want, total = np.zeros(emit.shape), 0.0
    for path in np.ndindex(*[emit.shape[1]] * len(emit)):
        p = np.exp(start[path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:]))) * np.prod([emit[t, y] for t, y in enumerate(path)])
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
    return want / total, total


def test_posteriors_are_those_of_whole_chains():
    rng = np.random.default_rng(0)
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    counts = np.array([4, 1, 6])
    emit = rng.random((11, 3)).astype(np.float32)
    want = np.concatenate([slow_posteriors(e, trans, start)[0] for e in np.split(emit, np.cumsum(counts)[:-1])])
    for link in (1, 2, 4, 64):
        assert np.allclose(language_id.chain_posteriors(emit, counts, trans, start, link), want, atol=1e-5)
    # A long chain whose languages stick: what the first word says matters to the last link.
    sticky, counts = np.array([[3.0, -9], [-9, 3.0]]), np.array([700, 900])
    emit = np.full((1600, 2), 0.5, np.float32)
    emit[0], emit[700] = [0.9, 0.1], [0.1, 0.9]
    whole = language_id.chain_posteriors(emit, counts, sticky, np.zeros(2), 2000)
    assert np.allclose(language_id.chain_posteriors(emit, counts, sticky, np.zeros(2), 64), whole, atol=1e-4)
    assert whole[699, 0] > 0.88 and whole[-1, 1] > 0.88


def test_language_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(1)
    ids, gold = rng.integers(0, 6, (3, 4)), rng.integers(0, 3, (3, 4))
    values = [rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)]
    total, *slopes = language_id.likelihood(ids, gold, *values, 2)
    direct = 0.0
    for own, y in zip(ids, gold):
        z = slow_posteriors(np.exp(values[0][own]), values[1], values[2])[1]
        direct += values[0][own, y].sum() + values[1][y[:-1], y[1:]].sum() + values[2][y[0]] - np.log(z)
    assert np.isclose(total, direct)
    for value, slope in zip(values, slopes):
        for at in np.ndindex(value.shape):
            kept = value[at]
            value[at] = kept + 1e-5
            up = language_id.likelihood(ids, gold, *values, 2)[0]
            value[at] = kept - 1e-5
            down = language_id.likelihood(ids, gold, *values, 2)[0]
            value[at] = kept
            assert np.isclose((up - down) / 2e-5, slope[at], atol=1e-4)


def test_language_of_a_text_is_its_words_mean_posterior():
    train = {"en": [b"the cat and the dog with the house".split()] * 5, "de": ["der Hund und die Katze mit dem Haus".encode().split()] * 5}
    field = language_id.train(train)
    text = b"the Hund and die cat"
    emit = np.stack([np.exp([sum(field.weight[k][b] for b in language_id.ngrams([w], language_id.SIZES, language_id.BUCKETS)[1]) / len(language_id.ngrams([w], language_id.SIZES, language_id.BUCKETS)[1]) for k in range(2)]) for w in text.lower().split()])
    mean = slow_posteriors(emit, field.trans, field.start)[0].mean(0)
    found = language_id.label_texts([b"", text, None], field, WordTable(field.words))
    assert found[0] == ["und", field.languages[int(mean.argmax())], "und"] and abs(found[1][1] - mean.max()) < 1e-5


def test_scores_on_nasty_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, (i or 0) % 2, (i or 0) % 2) for i, _ in corpus()] + [(5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality.document_statistics(docs)
    for where, label in ((F.lit(True), labels), (F.lit(False), labels), (F.lit(True), labels.limit(0))):
        rows = quality.quality_scores(stats, quality.quality_model(stats, label, where)).collect()
        assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        model = toxicity.toxicity_model(docs, label, where)
        rows = toxicity.toxicity_scores(docs, model).collect()
        assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert quality.document_statistics(empty).count() == toxicity.toxicity_scores(empty, model).count() == 0


def test_isotonic_rises():
    p = quality.isotonic(np.array([1.0, 0, 3, 2, 5]), np.array([2.0, 1, 5, 5, 5]))
    assert (np.diff(p) >= 0).all() and p[-1] == 1


def test_toxicity_finds_misspelt_words():
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("mor", "tel", "san", "ruk", "ven") for b in ("ado", "ine", "ol", "ug", "ash")]
    clean = [" ".join(rng.choices(words, k=40)).encode() for _ in range(300)]
    toxic = [" ".join([*rng.choices(words, k=20), rng.choice(["wretchling", "wretchlings", "wretchlinger"]), *rng.choices(words, k=20)]).encode() for _ in range(150)]
    model = toxicity.train([(t, 0) for t in clean[:200]] + [(t, 1) for t in toxic])
    score = lambda t: model.logit(model.words(decontaminate.words_of(t)))
    assert score(b"morado telol sanug wretchlingz rukash") > 0 > max(map(score, clean[200:]))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_duckdb(name, same_rows):
    assert same_rows(queries()[name], oracle_sql()[name])


def test_registered():
    assert {n.split("_")[0] for n in queries()} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
