"""Encoding with a sentencepiece model and decoding again, by a table of distinct chunks.

The library puts a white-space marker before a text and for every space. Where no piece of a merge-based model holds a marker after
another character, no merge crosses the place before a run of markers: the ids of a text are those of its marked words, in order.
Each distinct marked word is segmented once by the library, decoded once, and looked up by every place that holds it. A line
feed that no piece holds cuts likewise. A model for which this isn't sure (another kind than merges, a normaliser, pieces defined by its user,
white space removed) encodes and decodes whole texts.

The table belongs to a worker process and keeps a bounded number of words: frequent words come early, so the later half goes when it is
full; a word that is gone is segmented again. A table of all words, joined by a shuffle, would send every place of every text through it.

Defined results: a null or empty text has no ids and decodes to an empty text; rows that repeat an id or have none are encoded each for
itself; texts of any length are encoded whole; further columns are not needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lists_of, small_batches, texts

MARK = "▁"
#: Marked words that a process keeps with their ids, and the length beyond which one isn't kept.
TABLE_ROOM = 400_000
TABLE_WORD = 64


@dataclass
class Chunks:
    """A model and its table: the ids of each distinct marked word as decimal text, and what it decodes to where that isn't itself."""

    model: object
    split: re.Pattern | None
    space: str
    ids: dict[bytes, bytes] = field(default_factory=dict)
    others: dict[bytes, bytes] = field(default_factory=dict)

    def learn(self, missing: list[bytes]) -> None:
        """Segment and decode marked words that the table doesn't hold."""
        marked = [w.startswith(b" ") for w in missing]
        # The library marks a text's begin itself: a word's own first marker goes, and a line's begin is left without one.
        found = self.model.encode([(w[1:] if m else w).decode("utf-8", "replace") for w, m in zip(missing, marked)], num_threads=1)
        found = [[self.space] if w == b" " else x if m else x[1:] for w, m, x in zip(missing, marked, found)]
        for w, m, x, text in zip(missing, marked, found, self.model.decode(found)):
            self.ids[w] = ",".join(map(str, x)).encode()
            text = b" " * m + text.encode()
            if text != w:
                self.others[w] = text

    def encode(self, batch: list[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of each text in decimal, joined by commas, and the text that they decode to."""
        if self.split is None:
            for ids in self.model.encode([(t or b"").decode("utf-8", "replace") for t in batch], num_threads=1):
                yield ",".join(map(str, ids)).encode(), self.model.decode(ids).encode()
            return
        mark = MARK.encode()
        words = [self.split.findall(b" " + t.replace(mark, b" ")) if t else [] for t in batch]
        missing = list(set().union(*words).difference(self.ids))
        self.learn(missing)
        for found in words:
            other = found if self.others.keys().isdisjoint(found) else [self.others.get(w, w) for w in found]
            yield b",".join(map(self.ids.__getitem__, found)), b"".join(other)[1:]
        for w in missing:
            if len(w) > TABLE_WORD:
                del self.ids[w]
                self.others.pop(w, None)
        if len(self.ids) > TABLE_ROOM:
            for w in list(self.ids)[TABLE_ROOM // 2 :]:
                del self.ids[w]
                self.others.pop(w, None)


_models: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    """This process's model of a path, with its table."""
    if path not in _models:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model, about = SentencePieceProcessor(model_file=path), sentencepiece_model_pb2.ModelProto()
        about.ParseFromString(model.serialized_model_proto())
        trainer, normal, kinds = about.trainer_spec, about.normalizer_spec, about.SentencePiece
        plain = trainer.model_type == trainer.BPE and not trainer.treat_whitespace_as_suffix and normal.add_dummy_prefix and normal.escape_whitespaces
        plain = plain and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap and not about.denormalizer_spec.precompiled_charsmap
        plain = plain and all(p.type != kinds.USER_DEFINED and not re.search(f"[^{MARK}]{MARK}", p.piece) for p in about.pieces)
        line = b"" if any("\n" in p.piece for p in about.pieces) else b"\\n"
        split = re.compile(rb" +[^ %b]*" % line + (rb"|\n[^ \n]*" if line else b""))
        alone = model.encode("x ")[len(model.encode("x")) :]
        _models[path] = Chunks(model, split if plain and len(alone) == 1 else None, alone[0] if len(alone) == 1 else -1)
    return _models[path]


def encoded(docs: DataFrame, path: str, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 of every document; with_text: also its ids and
    the decoded text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(path)
        for batch in batches:
            rows, ids, decoded = [], [], []
            for listed, text in table.encode(batch.column(1).to_pylist()):
                rows.append((listed.count(b",") + 1 if listed else 0, sha256(listed).hexdigest(), sha256(text).hexdigest()))
                if with_text:
                    ids.append(np.array(listed.split(b",") if listed else [], np.int32))
                    decoded.append(text)
            n, a, b = zip(*rows) if rows else [()] * 3
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_text:
                columns += [lists_of(np.concatenate([np.zeros(0, np.int32), *ids]), [len(x) for x in ids], pa.int32()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_text
    found = texts(docs, id_col, text_col).mapInArrow(run, kinds)
    return found.withColumn("decoded", F.col("decoded").cast("string")) if with_text else found
