"""Language identification: a linear-chain conditional random field labels every word; a text takes its words' mean posterior.

A word's score for each language is the mean of learned weights of its hashed features: affixes (n-grams that touch a boundary
mark), inner n-grams, and the word itself (the lexicon). Transitions are learned together with them by gradient ascent on the
likelihood, with forward-backward. Training chains are single-language and code-switched: spans of differently labelled
texts, joined. In scoring a whole text is one chain and every word is labelled. Its links of `LINK` words run side by side with those of
all texts of a batch: each starts from what its neighbours last told it, and runs again until they tell it nothing new.

Every label is learned. Learning uses at most about `rows` texts per language, chosen by a hash of doc_id, each with all its words;
`chains` training chains per language are made of spans from anywhere in them. Scoring reads whole texts.

Defined results: null, empty and letterless texts are `und` with score 0; without any labelled text everything is `und`; ties go
to the language that sorts first; rows with a null id are labelled as well; further columns of the input are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import hash_number, small_batches, texts
from cairn.llm.subwords import WordIds, WordTable, has_letter, ngrams

SIZES = (2, 3, 4)
BUCKETS = 1 << 16
#: A word byte: an ASCII letter or any byte of a longer UTF-8 sequence; the rest separates words.
LETTER_BYTES = bytes(b if chr(b).isalpha() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))
NO_LANGUAGE = "und"
#: Words of a text that run one after the other; its links run side by side.
LINK = 64


def letter_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(LETTER_BYTES).split()


@dataclass
class Field:
    languages: list[str]
    weight: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def words(self, words: list[bytes]) -> np.ndarray:
        """exp of each word's scores, the largest 1."""
        owner, bucket = ngrams(words, SIZES, BUCKETS)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        s = np.stack([np.bincount(owner, w[bucket], len(words)) for w in self.weight], 1) / n[:, None] if words else np.zeros((0, len(self.languages)))
        return np.exp(s - s.max(1, keepdims=True, initial=-np.inf)).astype(np.float32)


def forwards(emit: np.ndarray, before: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over [chains, words, languages] from the prediction of each chain's first word: the (scaled) forward terms, the prediction of the
    word after the last, and the log of what was scaled away."""
    out, log_z = np.empty_like(emit), np.zeros(len(emit))
    for t in range(emit.shape[1]):
        a = before * emit[:, t]
        z = a.sum(1, keepdims=True)
        out[:, t] = a / z
        log_z += np.log(z[:, 0])
        before = out[:, t] @ trans
    return out, before, log_z


def backwards(emit: np.ndarray, real: np.ndarray, after: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the backward term of each chain's last word: those of all words, and that of the word before the first; real marks the
    words that are no padding."""
    out = np.empty_like(emit)
    for t in range(emit.shape[1] - 1, -1, -1):
        out[:, t] = after
        b = (emit[:, t] * after) @ trans.T
        after = np.where(real[:, t, None], b / b.sum(1, keepdims=True), after)
    return out, after


def settled(emit: np.ndarray, first: np.ndarray, size: np.ndarray, told: np.ndarray, following: np.ndarray, run, tolerance: float = 1e-6) -> np.ndarray:
    """The terms of all words of chains that are cut into links, each `size` words from word `first` on.

    told: what each link is told at the start; run(emit, real, told) gives a block's terms and what its links tell the links `following`
    (-1: none). A link runs again when it is told something new, so the terms are those of the uncut chains.
    """
    terms = np.empty_like(emit)
    todo = np.arange(len(first))
    while len(todo):
        todo = todo[np.argsort(size[todo], kind="stable")]
        tells = np.empty_like(told[todo])
        for s in range(0, len(todo), 2048):
            links = todo[s : s + 2048]
            place = np.arange(int(size[links[-1]]))
            real = place < size[links, None]
            word = np.minimum(first[links, None] + place, len(emit) - 1)
            block, tells[s : s + 2048] = run(np.where(real[:, :, None], emit[word], np.float32(1)), real, told[links])
            terms[word[real]] = block[real]
        to = following[todo]
        tells, to = tells[to >= 0], to[to >= 0]
        tells = tells / tells.sum(1, keepdims=True)
        new = np.abs(tells - told[to]).max(1, initial=0) > tolerance
        told[to[new]] = tells[new]
        todo = to[new]
    return terms


def chain_posteriors(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: np.ndarray, link: int = LINK) -> np.ndarray:
    """[words, languages]: the posterior of each word of texts with these counts of words, each text one chain."""
    trans, start = np.exp(trans).astype(np.float32), np.exp(start).astype(np.float32)
    links = -(-counts // link)
    at = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    opens, closes = at == 0, at == np.repeat(links, links) - 1
    size = np.where(closes, np.repeat(counts, links) - at * link, link)
    first = np.cumsum(size) - size
    number = np.arange(len(at))
    even = np.full((len(at), emit.shape[1]), 1 / emit.shape[1], np.float32)
    before = np.where(opens[:, None], start / start.sum(), even)
    forward = settled(emit, first, size, before, np.where(closes, -1, number + 1), lambda e, real, told: forwards(e, told, trans)[:2])
    p = forward * settled(emit, first, size, even, np.where(opens, -1, number - 1), lambda e, real, told: backwards(e, real, told, trans))
    return p / p.sum(1, keepdims=True)


def likelihood(ids: np.ndarray, gold: np.ndarray, score: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of chains of words [chains, words] with their languages: the log-likelihood and its slopes by the words' scores, trans and start."""
    size = len(start)
    total, by_score, by_trans, by_start = 0.0, np.zeros_like(score), np.zeros_like(trans), np.zeros_like(start)
    for s in range(0, len(ids), block):
        own, y = ids[s : s + block], gold[s : s + block]
        top = score[own].max(2, keepdims=True)
        emit, real = np.exp(score[own] - top), np.ones(own.shape, bool)
        forward, _, log_z = forwards(emit, np.tile(np.exp(start), (len(own), 1)), np.exp(trans))
        backward, _ = backwards(emit, real, np.ones((len(own), size)), np.exp(trans))
        p = forward * backward
        p /= p.sum(2, keepdims=True)
        a, b = forward[:, :-1].reshape(-1, size), (emit[:, 1:] * backward[:, 1:]).reshape(-1, size)
        # Of each pair of neighbours, the joint posterior of their languages, summed over all pairs.
        joint = np.exp(trans) * (a.T @ (b / ((a @ np.exp(trans)) * b).sum(1, keepdims=True)))
        pairs = np.zeros_like(trans)
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        slope = np.eye(size)[y] - p
        for k in range(size):
            by_score[:, k] += np.bincount(own.ravel(), slope[:, :, k].ravel(), len(score))
        by_trans += pairs - joint
        by_start += slope[:, 0].sum(0)
        right = np.take_along_axis(score[own], y[:, :, None], 2)
        total += float((right - top).sum() + start[y[:, 0]].sum() + trans[y[:, :-1], y[:, 1:]].sum() - log_z.sum())
    return total, by_score, by_trans, by_start


def training_chains(texts_: dict[str, list[list[bytes]]], languages: list[str], chains: int, length: int, rng: np.random.Generator) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """A vocabulary, and `chains` chains of `length` words (by number) with their languages: every second of one language, the others of
    spans of several."""
    vocabulary = WordIds()
    ids, gold = np.zeros((chains, length), np.int64), np.zeros((chains, length), np.int64)
    for c in range(chains):
        t, y = 0, c // 2 % len(languages)
        while t < length:
            run = length if c % 2 else int(rng.integers(4, length // 2))
            found = texts_[languages[y]]
            words = found[rng.integers(len(found))]
            at = int(rng.integers(max(1, len(words) - run + 1)))
            part = words[at : at + min(run, length - t)]
            ids[c, t : t + len(part)] = [vocabulary[w] for w in part]
            gold[c, t : t + len(part)] = y
            t += len(part)
            if not c % 2:
                y = int(rng.integers(len(languages)))
    return vocabulary, ids, gold


def train(texts_: dict[str, list[list[bytes]]], seed: int = 5, chains: int = 400, length: int = 32, rounds: int = 30) -> Field:
    """A field learned from the words of texts of each language: `chains` chains a language."""
    rng = np.random.default_rng(seed)
    languages = sorted(y for y in texts_ if any(texts_[y]))
    texts_ = {y: [w for w in texts_[y] if w] for y in languages}
    size = len(languages)
    if not size:
        return Field([], np.zeros((0, BUCKETS)), np.zeros((0, 0)), np.zeros(0))
    n_chains = max(2, chains) * size
    vocabulary, ids, gold = training_chains(texts_, languages, n_chains, length, rng)
    owner, bucket = ngrams(list(vocabulary), SIZES, BUCKETS)
    n = np.bincount(owner, minlength=len(vocabulary))
    weight, trans, start = np.zeros((size, BUCKETS)), np.zeros((size, size)), np.zeros(size)
    block = max(1, (1 << 23) // (length * size))
    moments: dict[int, list[np.ndarray]] = {}
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(owner, w[bucket], len(vocabulary)) for w in weight], 1) / n[:, None]
        _, by_score, by_trans, by_start = likelihood(ids, gold, score, trans, start, block)
        by_word = by_score / n[:, None]
        to_weight = np.stack([np.bincount(bucket, by_word[owner, k], BUCKETS) for k in range(size)]) / n_chains - 1e-6 * weight
        for k, (value, g) in enumerate(((weight, to_weight), (trans, by_trans / n_chains - 1e-3 * trans), (start, by_start / n_chains))):
            m = moments.setdefault(k, [np.zeros_like(value), np.zeros_like(value)])
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g**2
            value += 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    return Field(languages, weight, trans, start)


def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, doc_id, text): the words of each whole text."""
    for batch in batches:
        words = [letter_words(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.binary()))], names=["lang", "doc_id", "words"])


def language_model(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 300, **how) -> Field:
    """A field learned from labelled texts that `where` (on doc_id) admits: of each language all, or about `rows` of them chosen by a hash of
    their ids, each whole; chains are made of spans from anywhere in them."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in base.groupBy("lang").count().collect()}
    if not counts:
        return train({})
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    sample = base.where(hash_number("doc_id") < shares[F.col("lang")]).select("lang", "doc_id", "text")
    found = sample.mapInArrow(whole_words, "lang string, doc_id long, words array<binary>").toArrow()
    samples: dict[str, list[list[bytes]]] = {y: [] for y in counts}
    for lang, _, words in sorted(zip(*(found.column(c).to_pylist() for c in range(3))), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        samples[lang].append(words)
    return train(samples, **how)


def label_texts(texts_: list[bytes | None], field: Field, table: WordTable) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    words = [letter_words(t) if has_letter(t) else [] for t in texts_]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum() or not field.languages:
        return [NO_LANGUAGE] * len(words), [0.0] * len(words)
    p = chain_posteriors(table([w for ws in words for w in ws]), counts[counts > 0], field.trans, field.start)
    owner = np.repeat(np.arange(len(words)), counts)
    mean = np.stack([np.bincount(owner, p[:, k], len(words)) for k in range(p.shape[1])], 1) / np.maximum(counts, 1)[:, None]
    best = mean.argmax(1)
    return [field.languages[b] if n else NO_LANGUAGE for b, n in zip(best, counts)], [min(1.0, float(mean[i, b])) if n else 0.0 for i, (b, n) in enumerate(zip(best, counts))]


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(held.value.words)
        for batch in batches:
            lang, score = label_texts(batch.column(1).to_pylist(), held.value, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
