"""Periodic runs of words: stretches that repeat one period several times over, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q, at least `least` words and at least `exponent` periods long, that no
neighbouring word extends keeping period q. All runs of a text come from its longest-previous-factor array: the suffix array (by
prefix doubling) and the common prefixes of its neighbours give, for each place, the longest stretch that begins there and also
earlier; these cut the text into LZ blocks. A run either touches the boundary of a block, and then extensions of every short enough period to both sides
of the boundary find it, or it lies strictly within a block, and then it is copied from the block's earlier occurrence, where it was
found before; runs stand in buckets by their start for that.

How long a period can be at a boundary b between blocks of l and r words: let a run of period p end in the block after b. If it begins
in the block before, its length, exponent * p or more, is l + r at most. If it begins earlier, it begins less than p words before
that block, as the block would else have an earlier occurrence that is longer than itself; so (exponent - 1) * p < l + r. Periods
up to (l + r) / (exponent - 1) are therefore enough, and all boundaries together have about as many as there are words.

Every three consecutive words of a run stand in it some exponent - 1 times, so places whose three words are rarer in their text belong
to no run. They are left out before the suffix array is built, by counts in hashed buckets, which can only keep too much; what
remains are stretches, each taken as a text of its own. A run and every longer stretch of its period remain together, so a run of a
stretch is one of the text.

Defined results: words are what stands between [\\x20\\x09-\\x0D]; a null or blank text has none, no runs and an empty collapsed text; rows that
repeat an id or have none are texts of their own; texts of any length are taken whole, within one task; further columns are not needed.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, texts

#: Words whose suffixes are sorted together, and pairs of places that are extended together; a longer text is sorted alone.
TOGETHER = 200_000
PAIRS = 1 << 20
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]


class Stretches:
    """Words of several stretches, one after another with an end mark behind each; ranks of all their substrings of 1, 2, 4, ... words, where
    equal ranks mean equal words of one stretch. Words of different stretches are different."""

    def __init__(self, word: np.ndarray, part: np.ndarray):
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True))
        self.n = n = len(word) + len(ends)
        number = np.zeros(len(word), np.int64)
        number[ends[:-1] + 1] = 1
        number = np.cumsum(number)
        symbol = np.zeros(n, np.int64)
        symbol[np.arange(len(word)) + number] = word + 1
        owner = np.empty(n, np.int64)
        owner[np.arange(len(word)) + number] = number
        owner[ends + np.arange(len(ends)) + 1] = np.arange(len(ends))
        self.owner = owner
        self.levels = []
        place, key, rank, width = np.arange(n), owner * (int(word.max()) + 2) + symbol, np.zeros(n, np.int32), 0
        while len(place):
            order = np.argsort(key, kind="stable")
            place, key = place[order], key[order]
            new = np.append(True, key[1:] != key[:-1])
            was = rank[place]
            fresh = np.append(True, was[1:] != was[:-1])
            at = np.arange(len(place))
            first, old = np.flatnonzero(new), np.flatnonzero(fresh)
            group = np.cumsum(new) - 1
            rank = rank.copy()
            rank[place] = was + (first[group] - old[np.cumsum(fresh) - 1])
            self.levels.append(rank)
            place = place[(np.diff(np.append(first, len(at))) > 1)[group]]
            width = max(1, 2 * width)
            key = rank[place].astype(np.int64) * n + rank[place + width]
        self.rank = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            same += (self.levels[k][i + same] == self.levels[k][j + same]).astype(np.int64) << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i < j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            a, b = i - same - (1 << k), j - same - (1 << k)
            same += ((a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
        return same

    def longest_previous(self) -> tuple[array, array]:
        """For each place the longest stretch that begins there and at an earlier place too, and one such earlier place."""
        n = self.n
        by_rank = np.empty(n, np.int64)
        by_rank[self.rank] = np.arange(n)
        common = np.zeros(n + 2, np.int64)
        common[2 : n + 1] = self.ahead(by_rank[:-1], by_rank[1:])
        held = lambda x: array("q", np.asarray(x, np.int64).tobytes())
        # Places leave from the last on, so the neighbours by rank that are left are always earlier ones.
        rank, sorted_at, shared = held(self.rank + 1), held(np.concatenate([[0], by_rank, [0]])), held(common)
        before, after = held(np.arange(n + 2) - 1), held(np.arange(n + 2) + 1)
        length, source = held(np.zeros(n)), held(np.zeros(n))
        for i in range(n - 1, -1, -1):
            r = rank[i]
            x, y = before[r], after[r]
            a, b = shared[r], shared[y]
            if a >= b:
                length[i], source[i], shared[y] = a, sorted_at[x], b
            else:
                length[i], source[i], shared[y] = b, sorted_at[y], a
            after[x] = y
            before[y] = x
        return length, source

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, source) of the LZ blocks: the longest previous factor, or one new word."""
        length, source = self.longest_previous()
        begin, at = array("q"), 0
        while at < self.n:
            begin.append(at)
            at += length[at] or 1
        b = np.frombuffer(begin, np.int64)
        return b, np.diff(np.append(b, self.n)), np.frombuffer(source, np.int64)[b]

    def at_boundaries(self, begin: np.ndarray, size: np.ndarray, least: int, exponent: int) -> np.ndarray:
        """[runs, (start, length, period)] of all runs that touch a boundary, with their smallest period each."""
        periods = (size + np.append(0, size[:-1])) // (exponent - 1)
        most = np.cumsum(periods)
        found = [np.zeros((0, 3), np.int64)]
        first = 0
        while first < len(begin):
            last = max(first + 1, int(np.searchsorted(most, (most[first - 1] if first else 0) + PAIRS)))
            count = periods[first:last]
            b = np.repeat(begin[first:last], count)
            p = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + 1
            first = last
            word = self.levels[0]
            # A run that touches b has a whole period behind it, or before it.
            for i, j in ((b, b + p), (b - p, b)):
                inside = (i >= 0) & (j < self.n)
                i, j, q = i[inside], j[inside], p[inside]
                some = (word[i] == word[j]) | (i > 0) & (word[i - 1] == word[j - 1])
                i, j, q = i[some], j[some], q[some]
                right = self.ahead(i, j)
                left = self.behind(i, j)
                run = np.stack([i - left, left + q + right, q], 1)
                found.append(run[(run[:, 1] >= exponent * q) & (run[:, 1] >= least)])
        runs = np.concatenate(found)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))] if len(runs) else runs

    def runs(self, least: int, exponent: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, in no order."""
        begin, size, source = self.blocks()
        bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for start, length, period in self.at_boundaries(begin, size, least, exponent).tolist():
            bucket[start].append((length, period))
        starts = sorted(bucket)
        wide = size >= least + 2
        for b, length, s in zip(begin[wide].tolist(), size[wide].tolist(), source[wide].tolist()) if starts else ():
            k = bisect_right(starts, s)
            # What is copied lands later in the list, where a block that overlaps its own source copies it on.
            while k < len(starts) and starts[k] + least < s + length:
                start = starts[k]
                inner = [r for r in bucket[start] if start + r[0] < s + length]
                if inner:
                    to = start + b - s
                    if to not in bucket:
                        insort(starts, to)
                    bucket[to] += inner
                k += 1
        return [(start, *r) for start, found in bucket.items() for r in found]


def repeated_places(word: np.ndarray, part: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, part) of the words that may belong to runs, as stretches: places where three words begin that are frequent enough in their part,
    so many in a row that a run fits, and the two words behind them."""
    index = np.arange(len(word))
    times, row = min(exponent - 1, max(least, exponent) - 2), max(least, exponent) - 2
    if times < 2:
        return index, part
    while len(index) > 2:
        w = word[index].astype(np.uint64)
        mixed = w[:-2] * _MIX[0] + w[1:-1] * _MIX[1] + w[2:] * _MIX[2] + (part[:-2].astype(np.uint64) + np.uint64(1)) * _MIX[3]
        mixed ^= mixed >> np.uint64(29)
        bits = max(10, int(len(index) * 8).bit_length())
        bucket = ((mixed * _MIX[0]) >> np.uint64(64 - bits)).astype(np.int64)
        kept = (np.bincount(bucket, minlength=1 << bits)[bucket] >= times) & (part[:-2] == part[2:])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        # Frequent places of neighbouring parts may stand side by side.
        cut = np.flatnonzero((part[1:-2] != part[:-3]) & kept[1:] & kept[:-1]) + 1
        begin, end = np.sort(np.append(begin, cut)), np.sort(np.append(end, cut))
        wide = end - begin >= row
        begin, size = begin[wide], (end - begin)[wide] + 2
        at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        was = len(index)
        index, part = index[at], np.repeat(np.arange(len(begin)), size)
        if len(index) > 0.9 * was:
            break
    return (index, part) if len(index) > 2 else (index[:0], part[:0])


def runs_of(documents: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Of each list of words, its runs (start, length, period) by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not sizes.sum():
        return found
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    word = np.fromiter((number[w] for d in documents for w in d), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(documents)), sizes)
    index, part = repeated_places(word, owner, least, exponent)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    while len(edges):
        end = max(1, int(np.searchsorted(edges, edges[0] + TOGETHER)))
        a, b = int(edges[0]), int(edges[end]) if end < len(edges) else len(index)
        edges = edges[end:]
        some = Stretches(word[index[a:b]], part[a:b])
        for start, length, period in some.runs(least, exponent):
            at = int(index[a + start - some.owner[start]])
            doc = int(owner[at])
            found[doc].append((at - int(first[doc]), length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, by start, then period) and collapsed (the text's words without repeats,
    joined by spaces) of every document; `exponent` is a whole number, 2 or more."""
    if exponent < 2 or least < exponent:
        raise ValueError("a run has at least two periods, and as many words")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bytes.split() splits at just the white space that words end at.
            documents = [(t or b"").split() for t in batch.column(1).to_pylist()]
            runs = runs_of(documents, least, exponent)
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(d) for d in documents], pa.int64()), pa.ListArray.from_arrays(ends, struct), pa.array([collapsed(d, r) for d, r in zip(documents, runs)], pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    found = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def figures(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the shortest period) with its exponent in thousandths, and digests."""
    better = lambda a, b: F.when((b["length"] > a["length"]) | (b["length"] == a["length"]) & ((b["start"] < a["start"]) | (b["start"] == a["start"]) & (b["period"] < a["period"])), b).otherwise(a)
    longest = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("longest", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", F.floor(1000 * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a periodic tail in the texts of one in ten ids: with h the crc32 of the id in decimal, g = h / 10 and n words, a text with h % 10 = 0
    repeats from word a = g % n on the first 1 + (n - a) / (3 + g % 8) words from there (whole divisions)."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("w").cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(F.col("w"), at(i).cast("int"))), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = docs.select("*", F.when(chosen, words).alias("w"))
    return split.withColumn(text_col, F.when(F.col("w").isNotNull() & (n > 0), tail).otherwise(F.col(text_col))).drop("w")
