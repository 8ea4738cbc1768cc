"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

Three transducers are compiled from the model file: the normaliser (a space before the text, each space
to the word mark), the pieces (a trie from characters to piece ids) and byte fallback (a character
that is no piece to the ids of its UTF-8 bytes). Composed with an input they give a lattice of
segmentations; its tropical-semiring shortest path is the encoding. The model at hand merges pairs by
rank, which no sum of piece weights can express, so weights stand on pairs: an arc that puts piece v
behind piece u costs 0 if merging the two pieces' text by rank gives u, v again, and infinity if not. A
segmentation whose neighbours all cost 0 is unique, and is the encoding by ranked merges; a shortest path
of weight 0 always exists. ``encode`` agrees with the public library id for id.
"""

from __future__ import annotations

import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import texts_of, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs that a worker remembers at most; then it forgets all.
REMEMBERED = 400_000
_NEVER = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number, and varint, fixed or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Transducer:
    """Normaliser, pieces and byte fallback of a model file with identity normalisation and ranked merges."""

    def __init__(self, model: bytes) -> None:
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte = [0] * 256
        self.output: list[bytes] = []
        normaliser = trainer = b""
        for number, value in _fields(model):
            if number == 2:
                trainer = value
            elif number == 3:
                normaliser = value
            elif number == 1:
                piece, score, kind = "", 0.0, 1
                for n, x in _fields(value):
                    if n == 1:
                        piece = x.decode()
                    elif n == 2:
                        score = struct.unpack("<f", x)[0]
                    elif n == 3:
                        kind = x
                i = len(self.output)
                if kind == 6:
                    self.byte[int(piece[3:5], 16)] = i
                    self.output.append(bytes([int(piece[3:5], 16)]))
                elif kind == 1:
                    self.ids[piece], self.rank[piece] = i, score
                    self.output.append(piece.replace(MARK, " ").encode())
                else:
                    self.output.append(b"")
        kinds = dict(_fields(trainer))
        rules = dict(_fields(normaliser))
        if kinds.get(3) != 2 or not kinds.get(35) or rules.get(2) or rules.get(4) != 0:
            raise ValueError("a model with ranked merges, byte fallback and identity normalisation is needed")
        self.dummy = rules.get(3, 1) == 1
        self.trie: dict = {}
        for piece in self.ids:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.follows: dict[str, dict[str, bool]] = {}
        self.held = 0
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by ranked merges: the best neighbours first, the leftmost of equals."""
        parts = list(text)
        rank = self.rank.get
        scores = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > _NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], _NEVER)
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], _NEVER)
        return parts

    def fits(self, u: str, v: str) -> bool:
        """Whether the arc from u (empty: the start) to v has weight 0."""
        if self.held > 4 * REMEMBERED:
            self.follows.clear()
            self.held = 0
        found = self.merged(u + v) == ([u, v] if u else [v])
        self.follows.setdefault(u, {})[v] = found
        self.held += 1
        return found

    def path(self, text: str) -> list[str]:
        """Shortest path through the lattice of a text: the one segmentation whose pairs all fit.

        From left to right, pieces are read off the trie at each position that a path of weight 0 reaches; an
        end keeps the last piece of the one such path that reaches it. The backward pass reads the pieces off.
        """
        n, trie, follows, fits = len(text), self.trie, self.follows, self.fits
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        for start in range(n):
            u = last[start]
            if u is None:
                continue
            known = follows.get(u) or follows.setdefault(u, {})
            node, at = trie, start
            while at < n and (node := node.get(text[at])) is not None:
                at += 1
                v = node.get("")
                if v is not None and last[at] is None:
                    found = known.get(v)
                    if fits(u, v) if found is None else found:
                        last[at] = v
            v = text[start]
            if last[start + 1] is None and v not in self.ids and fits(u, v):
                last[start + 1] = v
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a stretch between word marks; no piece has a mark behind another character."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            ids: list[int] = []
            for piece in self.path(word):
                known = self.ids.get(piece)
                ids.extend([known] if known is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")])
            found = tuple(ids)
            if len(word) < 64:
                self.words[word] = found
        return found

    def stretches(self, text: str) -> Iterator[str]:
        """The normalised text, cut where a mark follows another character, and long runs apart."""
        if not text:
            return
        text = (MARK if self.dummy else "") + text.replace(" ", MARK)
        pieces = text.split(MARK)
        if pieces[0]:
            yield pieces[0]
        marks = 0
        for word in pieces[1:]:
            marks += 1
            if word:
                yield MARK * marks + word
                marks = 0
        if marks:
            yield MARK * marks

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, find = self.words.get, self.word_ids
        for word in self.stretches(text):
            out.extend(known(word) or find(word))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, without the space put before. Control ids give nothing."""
        joined = b"".join([self.output[i] for i in ids])
        text = joined.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def transducer(model: bytes) -> Transducer:
    """Compiled once in a worker, which may serve many tasks."""
    key = hashlib.sha256(model).hexdigest()
    held = sys.__dict__.setdefault("_findloom_transducers", {})
    if key not in held:
        held.clear()
        held[key] = Transducer(model)
    return held[key]


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the
    UTF-8 of the text decoded from the ids) and lossless (whether that is the text).

    A null or empty text has no ids and is lossless. Texts are encoded whole. Repeated rows stay; other
    columns are dropped; empty input gives an empty result. The model file (0.5 MB, of fixed size) is
    read by the driver and travels with the tasks.
    """
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 200):  # ids of few texts at once
                part = batch.slice(at, 200)
                texts = [x.decode("utf-8", "replace") for x in texts_of(part)]
                ids = [machine.encode(x) for x in texts]
                flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                back = [machine.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                        pa.array([hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                        pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids", "ids_sha256", "decoded_sha256", "lossless"],
                )

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("n_ids", "long").add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string").add("lossless", "boolean")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Add column text, decoded from column ids; null ids give a null text."""
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            found = [None if x is None else machine.decode(x) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield with_columns(batch, {"text": pa.array(found, pa.string())})

    base = rows.drop("text")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("text", T.StringType())]))
