"""Context-tree weighting over bytes, with each byte taken as binary decisions.

A text is coded as its words, joined by spaces, and a line feed for the end. Every one of the 256 bytes has a codeword of 1 to `BITS` binary
decisions, a length-limited Huffman code of the training texts' bytes, so frequent bytes take few decisions. A context is the `depth`
bytes before, line feeds before the start of a text. At every context of every depth and every binary node a Krichevsky-Trofimov estimator
holds the counts of zeros and ones; a node's weighted probability halves between its own estimate and the product of its children's,
and a decision's probability mixes the estimates of all depths by the weights that follow. A context that training never saw has
nothing of its own to mix in: it predicts as the longest seen one above it.

The tree holds every context of every training text and grows with them; no task and no message holds it whole. The contexts' first
`TOP` bytes deal it to shards, whose number grows with the training texts. A first pass merges the counts of each shard and works every
subtree out up to its root; the driver mixes the contexts above the subtrees (of TOP - 1 bytes or fewer, 255 nodes each at most); a second
pass works the subtrees down again and answers for the grams (contexts with a byte) of each chunk of about `chunk` bytes of texts, which
then sums its answers per text. A chunk travels compressed, and its answers as float32.

The word frequencies of base_score are exact: words seen often go to the tasks as a dictionary of at most `max_hot` words, all
other words of a document are joined with the vocabulary.

Defined results: a null or empty text is the end alone; without training texts every decision has probability one half; rows that
repeat an id are scored each for itself; a null id counts as the empty text in the fold; a text of any length is scored whole, in
blocks; further columns of the input are not needed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, lists_of, small_batches, staged

#: The end token, as a word: no other word is empty.
END = b""
HALF = float(np.log(0.5))
#: Decisions of the longest codeword; a codeword stands left-justified in so many bits.
BITS = 12
#: Bytes of a context that deal it to a subtree; the driver holds what is above.
TOP = 3
#: A context must leave room for a codeword in 63 bits.
MOST_DEPTH = 6
#: Longer words are never in the tasks' dictionary, so that its size is bounded.
HOT_WORD_BYTES = 64
CODEC = pa.Codec("zstd", compression_level=1)
TEXT_CODEC = pa.Codec("zstd", compression_level=3)


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text): the words of a task and how often its texts hold them."""
    counts: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        rows = list(counts.items())
        counts.clear()
        for i in range(0, len(rows), 20_000):
            word, n = zip(*rows[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update((text or b"").lower().split())
            counts[END] += 1
        if len(counts) > 300_000:
            yield from flush()
    yield from flush()


def code_lengths_of(weights: list[float], most: int) -> list[int]:
    """Lengths of an optimal prefix code whose codewords have at most `most` bits (package-merge)."""
    leaves = sorted((w, (s,)) for s, w in enumerate(weights))
    row = leaves
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(leaves + pairs, key=lambda x: x[0])
    lengths = Counter(s for _, symbols in row[: 2 * len(weights) - 2] for s in symbols)
    return [lengths[s] for s in range(len(weights))]


@dataclass
class Alphabet:
    """word: each byte's codeword, left-justified in BITS bits; length: by codeword, its decisions."""

    word: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(histogram: np.ndarray) -> Alphabet:
        """A canonical code of bytes with these frequencies; bytes never seen have codewords as well."""
        lengths = code_lengths_of((histogram + 1e-3).tolist(), BITS)
        word, length, at = np.zeros(256, np.int64), np.zeros(1 << BITS, np.int8), 0
        for byte in sorted(range(256), key=lambda b: (lengths[b], b)):
            word[byte], length[at] = at, lengths[byte]
            at += 1 << (BITS - lengths[byte])
        return Alphabet(word, length)


def stream_of(text: bytes | None) -> bytes:
    """A text as it is coded."""
    return b" ".join((text or b"").lower().split()) + b"\n"


def words_in(stream: bytes) -> list[bytes]:
    return stream[:-1].split(b" ") if len(stream) > 1 else []


@dataclass
class Chunk:
    """The coded streams of some texts, each with a context of line feeds before it."""

    data: bytes
    lengths: np.ndarray
    depth: int

    @staticmethod
    def of(streams: list[bytes], depth: int) -> Chunk:
        pad = b"\n" * depth
        return Chunk(pad + pad.join(streams), np.fromiter(map(len, streams), np.int64, len(streams)), depth)

    def blocks(self, alphabet: Alphabet, size: int = 512 << 10) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In blocks of about `size` bytes: the gram at each byte (its context, the latest byte highest, then its codeword) and its text's place."""
        depth, after = self.depth, np.cumsum(self.lengths + self.depth)
        for a in range(depth, len(self.data), size):
            b = min(len(self.data), a + size)
            part = self.data[a - depth : b]
            # Backwards, the bytes before a byte follow it: a window of eight holds the byte and its context.
            windows = np.ndarray((b - a,), ">u8", part[::-1] + b"\0" * 8, strides=(1,))[::-1].astype(np.uint64)
            context = ((windows << np.uint64(8)) >> np.uint64(64 - 8 * depth)).astype(np.int64) if depth else np.zeros(b - a, np.int64)
            grams = (context << BITS) | alphabet.word[(windows >> np.uint64(56)).astype(np.int64)]
            first, last = np.searchsorted(after, [a, b - 1], "right")
            edges = np.clip(after[first : last + 1], a, b)
            text = np.repeat(np.arange(first, last + 1), np.diff(edges, prepend=a))
            inside = np.ones(b - a, bool)
            for start in (after - self.lengths - depth)[first : last + 2].tolist():
                inside[max(0, start - a) : max(0, start + depth - a)] = False
            yield grams[inside], text[inside]


def chunked(size: int):
    """Of (doc_id, held_out, text): consecutive rows in chunks of at least `size` bytes of streams, but for a task's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        ids: list = []
        held_out: list = []
        streams: list[bytes] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            one = [pa.array([x], t) for x, t in ((serial, pa.int64()), (ids, pa.list_(pa.int64())), (held_out, pa.list_(pa.bool_())), ([len(s) for s in streams], pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([*one, pa.array([packed_streams(streams)], pa.binary())], names=["chunk", "doc_id", "held_out", "lengths", "data"])

        for batch in batches:
            for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(doc_id)
                held_out.append(held)
                streams.append(stream_of(text))
                total += len(streams[-1])
                if total >= size:
                    yield chunk()
                    ids, held_out, streams, total, serial = [], [], [], 0, serial + 1
        if streams:
            yield chunk()

    return run


def packed_streams(streams: list[bytes]) -> bytes:
    return TEXT_CODEC.compress(b"".join(streams), asbytes=True)


def streams_in(data: bytes, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum(lengths)
    whole = TEXT_CODEC.decompress(data, decompressed_size=int(ends[-1]), asbytes=True)
    return [whole[e - n : e] for e, n in zip(ends.tolist(), lengths)]


def shard_of(grams: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """The shard of each gram, by the first bytes of its context."""
    prefix = (grams >> (BITS + 8 * (depth - min(TOP, depth)))).view(np.uint64)
    return ((prefix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % shards


def by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """The order by shard that keeps the order within each."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


def distinct(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams, sorted, and the sums of their counts."""
    at = np.argsort(grams, kind="stable")
    grams = grams[at]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[first], np.add.reduceat(n[at], first) if len(first) else n[:0]


def sorted_once(grams: np.ndarray) -> np.ndarray:
    """The distinct grams, sorted; sorts in place, which takes a fraction of the time of numpy's table of unique values."""
    grams.sort()
    return grams[np.diff(grams, prepend=-1) != 0]


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of whole numbers, place by place, compressed: sorted or small numbers leave places of zeros."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return CODEC.compress(planes, asbytes=True)


def unpacked(data: bytes, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(CODEC.decompress(data, decompressed_size=count * width), np.uint8).reshape(width, count).T
    return out.reshape(-1).view("<i8")


def packed_grams(grams: np.ndarray) -> bytes:
    return packed(np.diff(grams, prepend=0), 8)


def unpacked_grams(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpacked(data, count, 8))


def packed_logs(logs: np.ndarray) -> bytes:
    """Of float32: the bytes place by place, compressed."""
    return CODEC.compress(np.ascontiguousarray(logs.view(np.uint8).reshape(-1, 4).T), asbytes=True)


def unpacked_logs(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(CODEC.decompress(data, decompressed_size=4 * count), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.float32)


def chunk_grams(chunk: Chunk, held_out: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct grams of a chunk, and how often its training texts hold each."""
    keys, filled = np.empty(int(chunk.lengths.sum()), np.int64), 0
    for grams, text in chunk.blocks(alphabet):
        keys[filled : filled + len(grams)] = (grams << 1) | held_out[text]
        filled += len(grams)
    keys.sort()
    first = np.append(True, keys[1:] >> 1 != keys[:-1] >> 1).nonzero()[0]
    grams = keys[first] >> 1
    np.bitwise_and(keys, 1, out=keys)
    return grams, np.diff(first, append=len(keys)) - np.add.reduceat(keys, first)


def chunk_shards(held_alphabet, depth: int, shards: int):
    """Of chunks: per chunk and shard, the grams there and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held_out, lengths, data in zip(*(batch.column(c) for c in (0, 2, 3, 4))):
                chunk = Chunk.of(streams_in(data.as_py(), lengths.as_py()), depth)
                grams, n = chunk_grams(chunk, np.array(held_out.as_py(), np.int64), held_alphabet.value)
                shard = shard_of(grams, depth, shards)
                order = by_shard(shard, shards)
                own, first, counts = np.unique(shard[order], return_index=True, return_counts=True)
                parts = [order[i : i + k] for i, k in zip(first.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(counts, pa.int64()), pa.array([packed_grams(grams[x]) for x in parts]), pa.array([packed(n[x], 4) for x in parts])],
                    names=["chunk", "shard", "size", "grams", "n"],
                )

    return run


def byte_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (word, c): how often the training texts hold each byte."""
    total = np.zeros(256)
    for batch in batches:
        words, c = batch.column(0).to_pylist(), np.asarray(batch.column(1), float)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        total += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(c, lengths), 256)
        total[0x20] += c.sum()
    yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    product = x * (x + 1) * (x + 2)
    z = x + 3
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov estimate of a sequence with these counts, as a natural logarithm; in blocks, to bound memory."""
    out = np.empty(zeros.shape)
    for i in range(0, len(zeros), 8192):
        a, b = zeros[i : i + 8192], ones[i : i + 8192]
        out[i : i + 8192] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
    return out


def mix(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with these counts and the logs of their children's product: the weight of the own estimate, its probability of a one, and
    the log of the weighted probability."""
    own = log_kt(zeros, ones)
    weighted = HALF + np.logaddexp(own, children)
    return np.exp(HALF + own - weighted), estimate(zeros, ones), weighted


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A node's probability of a one; not a number where nothing was seen."""
    both = zeros + ones
    return np.where(both > 0, (ones + 0.5) / (both + 1), np.nan)


def above(key: np.ndarray, j: int) -> np.ndarray:
    """The key (a context, then the first j decisions) of the same node with the context's oldest byte forgotten."""
    return ((key >> (8 + j)) << j) | (key & ((1 << j) - 1))


@dataclass
class Mixed:
    """For nodes, on the way down: the mixture so far, the share that deeper contexts still have, and the last seen estimate of a one."""

    so_far: np.ndarray
    share: np.ndarray
    last: np.ndarray

    @staticmethod
    def nothing(n: int) -> Mixed:
        return Mixed(np.zeros(n), np.ones(n), np.full(n, 0.5))

    def at(self, rows: np.ndarray) -> Mixed:
        return Mixed(self.so_far[rows], self.share[rows], self.last[rows])

    def deeper(self, weight: np.ndarray, one: np.ndarray) -> Mixed:
        """With the nodes one context byte deeper mixed in; an unseen one takes all that is left, with the last estimate above."""
        unseen = np.isnan(one)
        weight, one = np.where(unseen, 1.0, weight), np.where(unseen, self.last, one)
        return Mixed(self.so_far + self.share * weight * one, self.share * (1 - weight), one)


class Subtrees:
    """The contexts from TOP bytes down, of sorted grams and their counts; those of one root must be whole.

    A context's node before decision j is named by the context and the j decisions taken, which are the first bits of the grams there.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, alphabet: Alphabet):
        self.grams, self.split = grams, min(TOP, depth)
        #: Per j: the grams that take a decision j and their rows among the deepest nodes; of each depth from the deepest, (rows among
        #: those above, weight, probability of a one); the highest's keys and sums.
        self.deciding: list[tuple[np.ndarray, np.ndarray]] = []
        self.levels: list[list[tuple]] = []
        self.highest: list[tuple] = []
        n = n.astype(float)
        decisions = alphabet.length[grams & ((1 << BITS) - 1)]
        for j in range(int(decisions.max(initial=0))):
            own = np.flatnonzero(decisions > j)
            part, count = grams[own], n[own]
            new = np.diff(part >> (BITS - j), prepend=-1) != 0
            first = np.flatnonzero(new)
            key, both = part[first] >> (BITS - j), np.add.reduceat(count, first)
            ones = np.add.reduceat(count * ((part >> (BITS - 1 - j)) & 1), first)
            zeros = both - ones
            levels = []
            weight, one, weighted = np.ones(len(key)), estimate(zeros, ones), log_kt(zeros, ones)
            for _ in range(depth - self.split):
                key, up = np.unique(above(key, j), return_inverse=True)
                levels.append((up, weight, one))
                zeros, ones, weighted = (np.bincount(up, x, len(key)) for x in (zeros, ones, weighted))
                weight, one, weighted = mix(zeros, ones, weighted)
            levels.append((None, weight, one))
            self.deciding.append((own, (np.cumsum(new) - 1).astype(np.int32)))
            self.levels.append(levels)
            self.highest.append((key, zeros, ones, weighted))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the contexts just above: (context and node, zeros, ones, log of the product of the children's weighted probabilities)."""
        out = []
        for j, (key, *values) in enumerate(self.highest):
            own, up = np.unique(above(key, j), return_inverse=True)
            out.append((node_name(own, j), *(np.bincount(up, x, len(own)) for x in values)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def logs(self, top: Top) -> np.ndarray:
        """log10 of the probability of each gram's byte in its context."""
        out = np.zeros(len(self.grams))
        for j, ((own, row), levels) in enumerate(zip(self.deciding, self.levels)):
            key = self.highest[j][0]
            mixed = top.of(above(key, j), j) if self.split else Mixed.nothing(len(key))
            for up, weight, one in reversed(levels):
                mixed = (mixed if up is None else mixed.at(up)).deeper(weight, one)
            one, bit = mixed.so_far[row], (self.grams[own] >> (BITS - 1 - j)) & 1
            out[own] += np.log10(np.where(bit == 1, one, 1 - one))
        return out


def node_name(key: np.ndarray, j: int) -> np.ndarray:
    """One number for a context of at most TOP - 1 bytes, its first j decisions and j."""
    return ((key << (BITS - j)) << 4) | j


class Top:
    """The contexts above the subtrees: of at most TOP - 1 bytes, with 255 nodes each at most."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray, depth: int):
        """node, zeros, ones, children: Subtrees.sums(), added up over all subtrees."""
        self.found = []
        for j in range(BITS):
            at = np.flatnonzero(node & 15 == j)
            key = node[at] >> (BITS - j + 4)
            at = at[np.argsort(key)]
            key, a, b, c = np.sort(key), zeros[at], ones[at], children[at]
            lowest, levels, up = key, [], None
            for d in range(min(TOP, depth)):
                if d:
                    key, up = np.unique(above(key, j), return_inverse=True)
                    a, b, c = (np.bincount(up, x, len(key)) for x in (a, b, weighted))
                    levels[-1] = (up, *levels[-1][1:])
                weight, one, weighted = mix(a, b, c)
                levels.append((None, weight, one))
            mixed = Mixed.nothing(len(key))
            for up, weight, one in reversed(levels):
                mixed = (mixed if up is None else mixed.at(up)).deeper(weight, one)
            self.found.append((lowest, mixed))

    def of(self, key: np.ndarray, j: int) -> Mixed:
        keys, mixed = self.found[j]
        return mixed.at(np.searchsorted(keys, key))


def bucket(c: Column) -> Column:
    """Counts by quarter powers of two."""
    return F.floor(F.log2(c) * 4).cast("int")


def least_bucket(histogram: dict[int, int], most: int) -> int:
    """The least bucket from which on at most `most` rows remain."""
    total = 0
    for b in sorted(histogram, reverse=True):
        total += histogram[b]
        if total > most:
            return b + 1
    return min(histogram, default=0)


def pieces(grams: np.ndarray, depth: int, size: int) -> list[slice]:
    """Parts of sorted grams that end where a root ends, of about `size` grams or one root."""
    root = grams >> (BITS + 8 * (depth - min(TOP, depth)))
    ends = np.append(np.flatnonzero(np.diff(root)) + 1, len(grams))
    chosen = ends[np.append(np.diff(ends // size) > 0, True)].tolist()
    return [slice(a, b) for a, b in zip([0, *chosen], chosen)]


def merged_shards(held_alphabet, depth: int, most: int = 1_000_000, size: int = 150_000):
    """Of (shard, size, grams, n) sorted by shard: rows of whole subtrees, with all their grams and their sums for the contexts above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, waiting = None, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            grams, n = distinct(*(np.concatenate(x) for x in zip(*parts)))
            for own in pieces(grams, depth, size):
                sums = Subtrees(grams[own], n[own], depth, held_alphabet.value).sums()
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now], pa.int32()), pa.array([own.start], pa.int64()), pa.array([own.stop - own.start], pa.int64()), pa.array([packed_grams(grams[own])]), pa.array([packed(n[own], 6)]), *(lists_of(x, [len(x)], t) for x, t in zip(sums, kinds))],
                    names=["shard", "place", "size", "grams", "n", "node", "zeros", "ones", "children"],
                )

        for batch in batches:
            for shard, count, grams, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if shard != now:
                    if parts:
                        yield from finished()
                    now, parts, waiting = shard, [], 0
                parts.append((unpacked_grams(grams, count), unpacked(n, count, 4)))
                waiting += count
                if waiting > most:
                    parts, waiting = [distinct(*(np.concatenate(x) for x in zip(*parts)))], 0
        if parts:
            yield from finished()

    return run


def shard_answers(held_top, held_alphabet, depth: int):
    """Of (shard, place, chunk, size, grams, n) sorted by shard, subtrees first: per chunk, the logs of its grams' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = held_top.value
        now, known, logs = None, [], []
        for batch in batches:
            out = []
            for shard, chunk, count, data, n in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
                if shard != now:
                    now, known, logs = shard, [], []
                grams = unpacked_grams(data, count)
                if chunk is None:
                    known.append(grams)
                    logs.append(Subtrees(grams, unpacked(n, count, 6), depth, held_alphabet.value).logs(top).astype(np.float32))
                    continue
                if len(known) > 1:
                    known, logs = [np.concatenate(known)], [np.concatenate(logs)]
                out.append((chunk, shard, count, packed_logs(logs[0][np.searchsorted(known[0], grams)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["chunk", "shard", "size", "logs"])

    return run


def figures(held_words, held_alphabet, depth: int, shards: int):
    """Of (chunk, shard, size, logs, doc_id, held_out, lengths, data) sorted by chunk, the texts last: per text the tree's score, what
    frequent words contribute, and the other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c = held_words.value
        place = dict(zip(words, range(len(words))))
        log_c = np.append(np.log10(c + 0.5), 0.0)

        def scores(chunk: Chunk, logs: list[np.ndarray]) -> np.ndarray:
            parts = []
            for grams, text in chunk.blocks(held_alphabet.value):
                starts = np.flatnonzero(np.diff(text, prepend=-1))
                grams, at = np.unique(grams, return_inverse=True)
                parts.append((grams, at.astype(np.int32), starts, text[starts]))
            keys = sorted_once(np.concatenate([grams for grams, _, _, _ in parts]))
            by_gram = np.empty(len(keys), np.float32)
            by_gram[by_shard(shard_of(keys, depth, shards), shards)] = np.concatenate(logs)
            out = np.zeros(len(chunk.lengths))
            for grams, at, starts, text in parts:
                out[text] += np.add.reduceat(by_gram[np.searchsorted(keys, grams)].astype(float)[at], starts)
            return out

        def done(number: int, doc_ids: pa.Array, held_out: pa.Array, streams: list[bytes], logs: list[np.ndarray]) -> pa.RecordBatch:
            chunk = Chunk.of(streams, depth)
            tree = scores(chunk, logs)
            logs.clear()
            columns: list[list] = [[], [], []]
            tails, tail_counts, sizes = [], [], []
            for stream in streams:
                tokens = [*words_in(stream), END]
                at = np.fromiter(map(place.get, tokens, [len(words)] * len(tokens)), np.int64, len(tokens))
                tail = Counter([t for t, i in zip(tokens, at.tolist()) if i == len(words)]) if (at == len(words)).any() else {}
                for column, value in zip(columns, (len(tokens), int((at < len(words)).sum()), float(log_c[at].sum()))):
                    column.append(value)
                tails += tail.keys()
                tail_counts += tail.values()
                sizes.append(len(tail))
            kind = pa.struct([("word", pa.binary()), ("n", pa.int64())])
            flat = pa.StructArray.from_arrays([pa.array(tails, pa.binary()), pa.array(tail_counts, pa.int64())], fields=list(kind))
            tail_column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            n = len(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), doc_ids, held_out, pa.array(columns[0], pa.int64()), pa.array(chunk.lengths), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(tree), tail_column],
                names=["chunk", "place", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "tree", "tail"],
            )

        logs: list[np.ndarray] = []
        for batch in batches:
            for k, is_texts in enumerate(batch.column(1).is_null().to_pylist()):
                row = batch.slice(k, 1)
                if is_texts:
                    yield done(row.column(0)[0].as_py(), row.column(4).flatten(), row.column(5).flatten(), streams_in(row.column(7)[0].as_py(), row.column(6)[0].as_py()), logs)
                    logs = []
                else:
                    logs.append(unpacked_logs(row.column(3)[0].as_py(), row.column(2)[0].as_py()))

    return run


def tree_figures(chunks: DataFrame, words, alphabet: Alphabet, depth: int, shards: int) -> DataFrame:
    """figures of all chunks, by the tree of their training texts; deletes the chunks."""
    context = chunks.sparkSession.sparkContext
    held = context.broadcast(alphabet)
    dealt = staged(chunks.mapInArrow(chunk_shards(held, depth, shards), "chunk long, shard int, size long, grams binary, n binary"), "grams")
    sums = "node array<long>, zeros array<double>, ones array<double>, children array<double>"
    merged = dealt.select("shard", "size", "grams", "n").repartition("shard").sortWithinPartitions("shard")
    subtrees = staged(merged.mapInArrow(merged_shards(held, depth), f"shard int, place long, size long, grams binary, n binary, {sums}"), "subtrees")
    nodes = subtrees.select(F.explode(F.arrays_zip("node", "zeros", "ones", "children")).alias("x")).groupBy("x.node").agg(*(F.sum(f"x.{c}").alias(c) for c in ("zeros", "ones", "children"))).toArrow()
    top = context.broadcast(Top(*(np.asarray(nodes.column(c)) for c in range(4)), depth))
    asked = dealt.select("shard", F.lit(None).cast("long").alias("place"), "chunk", "size", "grams", F.lit(None).cast("binary").alias("n"))
    both = subtrees.select("shard", "place", F.lit(None).cast("long").alias("chunk"), "size", "grams", "n").union(asked)
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first(), "place")
    answers = both.mapInArrow(shard_answers(top, held, depth), "chunk long, shard int, size long, logs binary")
    kinds = (("doc_id", "array<long>"), ("held_out", "array<boolean>"), ("lengths", "array<long>"), ("data", "binary"))
    texts = chunks.select("chunk", *(F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("size", "long"), ("logs", "binary"))), *(c for c, _ in kinds))
    whole = answers.select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds)).union(texts)
    whole = whole.repartition("chunk").sortWithinPartitions("chunk", F.col("shard").asc_nulls_last())
    out = "chunk long, place int, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, tree double, tail array<struct<word:binary,n:long>>"
    found = staged(whole.mapInArrow(figures(words, held, depth, shards), out), "figures")
    dropped(chunks, dealt, subtrees)
    return found


def code_lengths(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 6, max_hot: int = 100_000, chunk: int = 6 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    score is log10 of the tree's probability of the text, base_score that of the smoothed word frequencies; `held_out` (on doc_id)
    tells which rows are not learned from. There is a shard for every `shard_bytes` of training texts, 32 at least.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0 to {MOST_DEPTH}")
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).select("doc_id", held_out.alias("held_out"), "text")
    vocabulary = staged(base.where(~F.col("held_out")).select("text").mapInArrow(token_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.col("c") * (F.octet_length("word") + 1)), F.lit(0)).alias("bytes")).first()
    histogram = np.zeros(256)
    for r in vocabulary.mapInArrow(byte_histogram, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r["byte"]] = r["n"]
    short = vocabulary.where(F.octet_length("word") <= HOT_WORD_BYTES)
    sizes = {r.b: r["count"] for r in short.groupBy(bucket(F.col("c")).alias("b")).count().collect()}
    found = short.where(bucket(F.col("c")) >= least_bucket(sizes, max_hot)).toArrow()
    hot = spark.sparkContext.broadcast((found.column(0).to_pylist(), np.asarray(found.column(1))))
    chunks = staged(base.mapInArrow(chunked(chunk), "chunk long, doc_id array<long>, held_out array<boolean>, lengths array<long>, data binary"), "chunks")
    first = tree_figures(chunks, hot, Alphabet.of(histogram), depth, max(32, totals.bytes // shard_bytes))
    tail = first.select("chunk", "place", F.explode("tail").alias("t")).select("chunk", "place", "t.word", "t.n").join(vocabulary, "word", "left")
    sums = tail.groupBy("chunk", "place").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("tail_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_base"))
    whole = float(np.log10(totals.n + 0.5 * (totals.v + 1)))
    return first.drop("tail").join(sums, ["chunk", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"), F.col("tree").alias("score"), (-F.col("tree") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
