"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces runs once over the text; at each
position its output links name every piece that ends there, and each relaxes
the best score of that position (Viterbi: the largest sum of piece scores).
Ties keep the longest last piece.  A character that is no piece, and at which no
piece ends, costs `UNKNOWN` below the least score and becomes its UTF-8 bytes.

Spaces are part of the pieces: one is put in front of a text and taken away in
decoding, so decode(encode(x)) = x for every text, U+2581 included (it becomes
bytes).  No piece holds a space after another character or a line feed (this is
checked), so the search starts afresh there; the same stretch is searched once
and remembered, up to twice `MEMORY` stretches.

Defined cases: null text gives null ids, empty text no ids; a null or empty
list decodes to null or the empty text.  Texts of any length are encoded whole, a
stretch at a time.  Repeated rows get a row each, no rows give none.  A column named
like the added one is replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bounded_batches, fresh, named, positional, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
MEMORY = 400_000
MARK = "▁"


@dataclass
class Vocabulary:
    pieces: list[str]  # spaces as spaces
    scores: list[float]
    ids: list[int]
    byte_ids: list[int]  # of the 256 byte pieces


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary([p.id_to_piece(i).replace(MARK, " ") for i in plain], [p.get_score(i) for i in plain], plain, byte_ids)


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.byte_ids = v.byte_ids
        self.single = {p for p in v.pieces if len(p) == 1}
        self.penalty = min(v.scores, default=0.0) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in zip(v.pieces, v.scores, v.ids):
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        apart = not any(regex.search(r"[^ ] |\n", p) for p in v.pieces)
        self.stretch = regex.compile(r"\n| *[^ \n]+| +") if apart else regex.compile(r"(?s).+")
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def search(self, text: str) -> list[int]:
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        last: list[tuple] = [(1, 0.0, -1)] * (n + 1)
        if self.single.issuperset(text):
            for end, piece in self.automaton.iter(text):
                total = best[end + 1 - piece[0]] + piece[1]
                if total > best[end + 1]:
                    best[end + 1], last[end + 1] = total, piece
        else:
            done = 0
            for end, piece in self.automaton.iter(text):
                while done < end:
                    done += 1
                    self._unknown(text, done, best)
                total = best[end + 1 - piece[0]] + piece[1]
                if total > best[end + 1]:
                    best[end + 1], last[end + 1] = total, piece
            while done < n:
                done += 1
                self._unknown(text, done, best)
        out: list[int] = []
        while n:
            length, _, i = last[n]
            if i < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
            else:
                out.append(i)
            n -= length
        return out[::-1]

    def _unknown(self, text: str, end: int, best: list[float]) -> None:
        """A character before `end` that is no piece, and ends none: bytes."""
        if text[end - 1] not in self.single and best[end] == float("-inf"):
            best[end] = best[end - 1] + self.penalty

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for unit in self.stretch.findall(" " + text) if text else ():
            ids = known.get(unit)
            if ids is None:
                ids = self.older.get(unit)
                if ids is None:
                    ids = self.search(unit)
                if len(unit) <= 64:
                    if len(known) >= MEMORY:
                        self.older, self.known = known, (known := {})
                    known[unit] = ids
            extend(ids)
        return out


class Decoder:
    def __init__(self, v: Vocabulary) -> None:
        self.table = {i: p.encode() for p, i in zip(v.pieces, v.ids)} | {i: bytes([b]) for b, i in enumerate(v.byte_ids)}

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 and unknown ids become U+FFFD."""
        raw = b"".join([self.table.get(i, b"\xef\xbf\xbd") for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _mapped(docs: DataFrame, kept: list[str], source: str, name: str, kind: T.DataType, make: type, of: Vocabulary, method: str, arrow: pa.DataType) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kept = without(kept, (name,))
    (held,) = fresh([*kept, name], "in")
    sent = docs.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = getattr(_worker(sent, make), method)
        for batch in batches:
            column = batch.column(len(kept))
            if source == "text":
                values = [None if x is None else call(x) for x in column.to_pylist()]
                cut = np.concatenate(([0], np.cumsum([len(x or ()) for x in values]))).astype(np.int32)
                flat = np.fromiter((i for x in values if x for i in x), np.int32, cut[-1])
                out = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat), mask=pa.array([x is None for x in values]) if None in values else None)
            else:
                out = pa.array([None if not x.is_valid else call(x.values.to_numpy(zero_copy_only=False).tolist() if len(x) else ()) for x in column], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], out], names=[*kept, name])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, kind)])
    return positional(docs.select(*named(kept), F.col(source).alias(held))).mapInArrow(run, schema)


_WORKER: dict = {}


def _worker(sent, make: type):  # noqa: ANN001, ANN202
    """One automaton for each worker process and vocabulary."""
    key = (make.__name__, sent._jbroadcast.id() if getattr(sent, "_jbroadcast", None) else getattr(sent, "_path", None))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make(sent.value)
    return _WORKER[key]


def encode(docs: DataFrame, v: Vocabulary, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (all) of docs and ids, the pieces of its text."""
    return _mapped(docs, docs.columns if kept is None else kept, "text", "ids", T.ArrayType(T.IntegerType()), Encoder, v, "encode", pa.list_(pa.int32()))


def decode(rows: DataFrame, v: Vocabulary, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (all) of rows and text, decoded from its ids."""
    return _mapped(rows, rows.columns if kept is None else kept, "ids", "text", T.StringType(), Decoder, v, "decode", pa.string())
