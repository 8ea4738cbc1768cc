"""Numpy kernels on batches of UTF-8 texts: words, lines and their rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of text that a kernel takes at once; a longer text is taken alone.
CHUNK = 1 << 20


def whitespace_table() -> np.ndarray:
    """1 for each byte of a word, 0 for ASCII white space."""
    table = np.ones(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes in all, or of one text."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


class Texts:
    """Texts joined by line ends, with the hash of any span in constant time.

    ``start[i]`` is where text i starts; ``span_hash`` takes arrays of bounds. Hashes have 64 bits, so
    that two different spans of one batch practically never meet.
    """

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        n = len(self.bytes)
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        value = mix((self.bytes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(value * power, out=self._sum[1:])
        back = np.full(n + 1, _INVERSE & _MASK, np.uint64)
        back[0] = 1
        self._back = np.multiply.accumulate(back)
        lead = (self.bytes & 0xC0) != 0x80
        self._chars = np.zeros(n + 1, np.int64)
        np.cumsum(lead, out=self._chars[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._back[start])

    def span_chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._chars[end] - self._chars[start]

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes whose entry in ``table`` isn't 0: starts, ends and the text of each."""
        inside = table[self.bytes] != 0
        inside[self.end] = False
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return start, end, np.searchsorted(self.start, start, "right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.end] - total[self.start]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return found


def again(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before each key."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:]] = keys[order][1:] == keys[order][:-1]
    return found


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a column's texts; a null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """The batch with further columns."""
    added = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *columns])
