"""Each stage of the corpus pipeline against a brute-force version over the stage's own input, on given and on nasty documents."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cairn.llm import toxicity
from cairn.llm.common import fold
from cairn.llm.queries import table, vocabulary_path
from tests.llm.test_brute_force import slow_toxicity
from tests.llm.test_contracts import corpus

SMALL = "/root/testdata/sf0.001"
NAMES = ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like an operator's own, an order of columns of its own."""
    item = table(spark, SMALL, "benchmark").where("length(text) > 200").first().text
    toxic = table(spark, SMALL, "labels").where("toxic = 1").join(table(spark, SMALL, "documents"), "doc_id").orderBy("doc_id").first().text
    near = " ".join(f"w{k}" for k in range(100))
    texts = [*corpus(), (300, f"before {item} after"), (301, item.upper()), (302, toxic), (303, near), (304, near + " w100 w101"), (305, near.replace("w50", "x50")), (306, " ".join(f"v{k}" for k in range(60_000)))]
    rows = [(i if k % 2 else None, "R", i, None, t, "en" if k % 3 else None, k, "a", None if k % 4 else len(t or ""), 0.5, "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "component_id long, rest string, doc_id long, row int, text string, lang string, n_dropped int, drop string, n_chars long, score double, source string").repartition(3)


@pytest.fixture(scope="module", params=["given", "nasty"])
def stages(request, spark, tmp_path_factory):
    docs, out = table(spark, SMALL, "documents") if request.param == "given" else nasty(spark), []
    for k, (_, f) in enumerate(cp.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        f(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select([F.col(f"`{c}`") for c in df.columns]).collect())


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert [name for name, _ in cp.STAGES] == NAMES
    for before, after in stages[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    model = toxicity.toxicity_model(before, table(spark, SMALL, "labels"), fold("doc_id", 4) != 2)
    want = Counter(r for r in rows(before).elements() if slow_toxicity(model, r[before.columns.index("text")]) < 0.3)
    assert rows(after) == want


def test_lines_of_earlier_documents_go(stages):
    before, after = stages[1]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in texts(before):
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    at, want = {c: k for k, c in enumerate(before.columns)}, Counter()
    for r in rows(before).elements():
        i, t, r = r[at["doc_id"]], r[at["text"]], list(r)
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not holders[key(x)] or min(holders[key(x)]) == i]
        if len(kept) < len(lines):
            r[at["text"]], r[at["n_chars"]] = "\n".join(kept), len("\n".join(kept))
        want[tuple(r)] += 1
    assert rows(after) == want


def test_one_document_of_a_group_stays(stages):
    before, after = stages[2]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t))) for i, t in texts(before)]
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()) for i, w in words]
    own, group = {}, {}
    for i, s in sets:
        if i is not None:
            group[i] = min(i, own.get(s, i), group.get(i, i))
            own[s] = group[i]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if None not in (a, b) and (s == t or s and t and len(s & t) >= 0.8 * len(s | t) - 1e-9)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    at = before.columns.index("doc_id")
    assert rows(after) == Counter(r for r in rows(before).elements() if r[at] is None or group[r[at]] == r[at])


def test_no_test_item_is_left(spark, stages):
    before, after = stages[3]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in table(spark, SMALL, "benchmark").where("item_id IS NOT NULL").collect():
        w = words(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(g) for g in grams}
    hit = lambda w: any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))
    at = before.columns.index("text")
    assert rows(after) == Counter(r for r in rows(before).elements() if not hit(words(r[at])))


def test_all_is_packed(spark, stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    tokenizer, want = Tokenizer.from_file(vocabulary_path()), Counter()
    for i, t in texts(before):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), cp.SEQUENCE_TOKENS)):
            want[(i, k, s, len(ids[s : s + cp.SEQUENCE_TOKENS]), zlib.crc32(ids[s : s + cp.SEQUENCE_TOKENS].tobytes()))] += 1
    found = after.collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1]) and sum(n for _, n in parts) <= cp.SEQUENCE_TOKENS


def test_run_is_the_stages_in_a_row(spark, stages):
    before, after = stages[0][0], stages[-1][1]
    if before.columns == ["doc_id", "text", "lang", "source", "n_chars"]:
        key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
        assert key(cp.run(spark, SMALL)) == key(after)


def test_an_empty_table_stays_empty(spark):
    docs = nasty(spark).limit(0)
    for _, f in cp.STAGES:
        assert f(spark, docs, SMALL).count() == 0
