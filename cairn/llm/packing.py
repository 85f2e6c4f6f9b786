"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Every document becomes pieces of at most `capacity` tokens. What matters for packing is how many pieces have each length, and
there are at most `capacity` lengths, so the plan is made on that histogram, whatever the number of documents: dominance first
fixes small sets that some best packing contains, best fit places the rest in order of falling length. The plan says for
each length which of its pieces, counted from 0, go to which sequences at which offset; pieces get their count by windows over
salted lengths, so a popular length doesn't fill one task.

Defined results: a null or empty text is one piece with the end id alone; rows that repeat an id are packed each for itself
(their pieces carry equal ids); a null id is packed under null; further columns of the input are not needed.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, staged, texts

#: A full stop or comma between an ASCII letter and white space is a token of its own; apart, fewer distinct words need encoding.
STOP = re.compile(rb"[.,](?<=[A-Za-z][.,])(?=[ \n])")
#: Words that a process keeps with their ids. Beyond it the later half is forgotten: frequent words come early.
CACHE_ROOM = 400_000
CACHE_WORD = 64
#: How the vocabulary writes bytes: printable ones as they are, the others as characters from U+0100 on.
BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: Texts by which a vocabulary shows whether its words can be encoded one by one.
PROBES = ["Two Words", "  lead,  and\ttabs\nlines \r\n", "Don't a.b, c. d.\ne,f 'tis", "Größe ÉCOLE façade ǆ ﬁ ß", "12 3.5 a1b2 <b> @x #y $z", "a <|endoftext|> B <|unk|>c", "漢字かな 한글 нет", "", " ", "x" * 300]
_caches: dict[str, tuple[object, object, dict[bytes, bytes], bool]] = {}


def encoder(path: str):
    """The tokenizer, its model, this process's cache of words' ids as bytes, and whether the ids of a text are those of its words."""
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        probes = [p.encode() for p in PROBES]
        try:
            by_word = ids_by_word(probes, tokenizer, tokenizer.model, {}) == whole_ids(probes, tokenizer)
        except Exception:  # noqa: BLE001  (a model that can't take a single word)
            by_word = False
        _caches[path] = tokenizer, tokenizer.model, {}, by_word
    return _caches[path]


def whole_ids(documents: list[bytes | None], tokenizer) -> list[bytes]:
    """Each text's ids, by the tokenizer's own way."""
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return [array("I", e.ids).tobytes() for e in encode([(t or b"").decode("utf-8", "replace") for t in documents], add_special_tokens=False)]


def plain(word: bytes) -> bool:
    """Whether the tokenizer's normaliser and splitter surely leave the word as it is: lower-case Latin letters in composed form."""
    if word.isalpha():
        return word.islower()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text)


def token_bytes(documents: list[bytes | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    tokenizer, model, cache, by_word = encoder(path)
    return ids_by_word(documents, tokenizer, model, cache) if by_word else whole_ids(documents, tokenizer)


def ids_by_word(documents: list[bytes | None], tokenizer, model, cache: dict[bytes, bytes]) -> list[bytes]:
    """Each text's ids, for a vocabulary that drops white space and lower-cases, none of whose tokens spans ASCII white space: they are the
    ids of its words in order, and each distinct word is encoded once."""
    split = []
    for text in documents:
        text = text or b""
        # Special tokens keep their case in the vocabulary; a text that may hold one isn't lower-cased.
        split.append(STOP.sub(rb" \g<0>", text if b"<|" in text else text.lower()).split())
    missing = list(set().union(*split).difference(cache))
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    others = []
    for word in missing:
        if plain(word):
            cache[word] = array("I", [t.id for t in model.tokenize(word.decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
        else:
            others.append(word)
    for i in range(0, len(others), 4096):
        part = others[i : i + 4096]
        for word, e in zip(part, encode([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
            cache[word] = array("I", e.ids).tobytes()
    out = [b"".join(map(cache.__getitem__, words)) for words in split]
    for word in missing:
        if len(word) > CACHE_WORD:
            del cache[word]
    if len(cache) > CACHE_ROOM:
        for word in list(cache)[CACHE_ROOM // 2 :]:
            del cache[word]
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                rows += [(doc_id, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
            a, b, c, d, e = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Slots (length, first, after, sequence, each, offset): pieces first to after - 1 of a length go to sequences from
    `sequence` on, `each` to one, the first at `offset` and the others behind it."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def put(self, length: int, sequence: int, n: int, each: int, offset: int) -> None:
        """n pieces of a length, `each` to a sequence from `sequence` on."""
        k = self.used[length]
        self.slots.append((length, k, k + n, sequence, each, offset))
        self.used[length] = k + n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], n: int) -> None:
        """n sequences that hold just these lengths."""
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            self.put(length, self.sequences, n * each, each, offset)
            offset += each * length
        self.sequences += n

    def reduce(self) -> None:
        """Martello and Toth: a set of pieces with s dominates if every other set with s that fits can be swapped for it."""
        sizes = sorted(self.left)

        def without(*gone: int) -> None:
            for g in set(gone):
                at = bisect_left(sizes, g)
                if g not in self.left and sizes[at : at + 1] == [g]:
                    sizes.pop(at)

        again = True
        while again:
            again = False
            for s in sorted(self.left, reverse=True):
                while s in self.left:
                    room = self.capacity - s
                    small = self.smallest(sizes, s)
                    i = bisect_right(sizes, room)
                    if i and sizes[i - 1] == s and self.left[s] < 2:
                        i -= 1
                    if not i or not small or small[0] > room:
                        self.fix([s], self.left[s])
                    elif (t := sizes[i - 1]) == room or len(small) < 2 or small[0] + small[1] > room or (sum(small) > room or len(small) < 3) and t >= self.best_pair(sizes, s, room):
                        self.fix([s, t], self.left[s] // 2 if s == t else min(self.left[s], self.left[t]))
                        without(t)
                    else:
                        break
                    without(s)
                    again = True

    def smallest(self, sizes: list[int], s: int) -> list[int]:
        """The three smallest pieces besides one of length s."""
        out: list[int] = []
        for x in sizes[:4]:
            out += [x] * min(3, self.left[x] - (x == s))
        return out[:3]

    def best_pair(self, sizes: list[int], s: int, room: int) -> int:
        """The largest sum of two pieces besides s that fits."""
        best, a, b = 0, 0, bisect_right(sizes, room) - 1
        while a <= b:
            x, y = sizes[a], sizes[b]
            enough = self.left[x] - (x == s) >= 1 and self.left[y] - (y == s) >= 1 and (x != y or self.left[x] - (x == s) >= 2)
            if x + y > room:
                b -= 1
            else:
                best = max(best, x + y if enough else 0)
                a += 1
        return best

    def best_fit(self) -> None:
        """Falling lengths, each into the open sequences with the least room that suffices."""
        rooms: list[int] = []
        open_at: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_at:
                    insort(rooms, room)
                open_at.setdefault(room, []).append((first, n))

        for s in sorted(self.left, reverse=True):
            while s in self.left:
                n = self.left[s]
                i = bisect_left(rooms, s)
                if i < len(rooms):
                    room = rooms[i]
                    first, bins = open_at[room].pop()
                    if not open_at[room]:
                        del open_at[room]
                        rooms.pop(i)
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-n // (room // s))
                    self.sequences += bins
                each = room // s
                full = min(bins, n // each)
                if full:
                    self.put(s, first, full * each, each, self.capacity - room)
                    keep(room - each * s, first, full)
                if full < bins:
                    some = n - full * each if full * each < n else 0
                    if some:
                        self.put(s, first + full, some, some, self.capacity - room)
                        keep(room - some * s, first + full, 1)
                    keep(room, first + full + bool(some), bins - full - bool(some))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", salted: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Pieces of one length are numbered in parts of about `salted`, by a hash, so that a length that many share fills many tasks.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    salts = max(8, -(-max(counts.values(), default=0) // salted))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    plan = Plan(counts, capacity)
    slots = spark.createDataFrame(plan.slots or [(0, 0, 0, 0, 1, 0)], "slot_length long, first long, after long, sequence long, each long, base long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = cut.groupBy("length", "salt").count().select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("n", F.row_number().over(within) - 1).join(groups, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("n") + F.col("skip"))
    # One slot row per length and run of pieces: at most a few per length, so this side is bounded by the capacity.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    k = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + (k % F.col("each")) * F.col("length")).alias("offset"))
