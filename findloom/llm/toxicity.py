"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, give the probability of each byte of a word after up to
``ORDER`` - 1 bytes before it in the word (the word's start and end count as bytes). Seen expressions
are discounted, and what the discounts leave goes to backoff counts that both models share: of how many
different expressions of all documents a byte ends after its last two bytes. An expression seen ``DISCOUNT``
times or less in a class has nothing but that backoff, so rare ones say little, and in places where neither
class has evidence the models agree.

A word's evidence is its toxic log-likelihood less its ordinary one, as far as it is over ``MARGIN``;
the sum over a text's words, divided by their number, becomes the score along a logistic curve. The
margin keeps the many small differences of ordinary words from drowning a few plain ones.

Words are learnt from ``LABELLED`` labelled documents at most, so the expressions with evidence, which
are what is broadcast, are bounded by that parameter. The shared counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .kernels import chunks, mix, texts_of, with_columns

#: Bytes of an expression, at most 6: it must fit in 48 bits.
ORDER = 6
#: Absolute discount of the class counts, and of the shared ones.
DISCOUNT, SHARED_DISCOUNT = 2, 0.75
MARGIN = 2.0
#: Labelled documents that are learnt from, at most (about; picked by a hash of their ids). Those with remainder 4 calibrate.
LABELLED = 200_000
#: Added to the mean evidence before its logarithm, in which the curve is logistic.
FLOOR = 1e-3
#: Expressions that a task gathers before it merges them.
GATHERED = 1 << 22
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = 32


def part_of(doc_id: Column) -> Column:
    """Remainder by 5 of the CRC-32 of the id's text: 0 is held out, 4 calibrates."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _letters() -> np.ndarray:
    """Whether each byte is part of a word: ASCII small letters and what isn't ASCII."""
    table = np.zeros(256, bool)
    table[97:123] = table[128:] = True
    return table


def expressions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The expressions of all texts, and the text of each.

    An expression is a byte of a word, or the blank behind one, and before it up to ``ORDER`` - 1 bytes,
    as far as the blank before the word. As a number, its last byte is the lowest.
    """
    joined = b"\n".join(x.translate(_LOWER) for x in texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = _letters()[raw]
    row = np.where(inside, raw, _BLANK).astype(np.int64)
    before = np.concatenate([[_BLANK], row[:-1]])
    at = np.flatnonzero(inside | (before != _BLANK))
    key = row[at]
    padded = np.concatenate([np.full(ORDER, _BLANK), row])
    reaches = np.ones(len(at), bool)
    for k in range(1, ORDER):
        byte = padded[at + ORDER - k]
        key |= np.where(reaches, byte, 0) << (8 * k)
        reaches &= byte != _BLANK
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return key, np.searchsorted(ends, at, "right")


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    toxic, ordinary = (np.bincount(where, np.concatenate([x[i] for x in held]), len(keys)).astype(np.int64) for i in (1, 2))
    return keys, toxic, ordinary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct expressions of what a task reads, with their counts in toxic and ordinary labelled texts."""
    held, size = [], 0
    for batch in batches:
        texts, label = texts_of(batch), batch.column(batch.schema.get_field_index("label")).to_pylist()
        for a, b in chunks(texts):
            key, owner = expressions(texts[a:b])
            kind = np.array([-1 if x is None else int(x) for x in label[a:b]], np.int64)[owner]
            held.append(_merged([(key, kind == 1, kind == 0)]))
            size += len(held[-1][0])
            if size > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names=["key", "t", "o"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names=["key", "t", "o"])


class Table:
    """Numbers by 64-bit key: open addressing in arrays, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several that want a place, the last gets it
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & (size - 1)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        """A table from another's arrays."""
        found = cls.__new__(cls)
        found.keys, found.values = keys, values
        return found

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys, 0 where there is none, and whether there is one."""
        at = self._home(keys)
        there = self.keys[at]
        found = there == keys
        out = np.where(found, self.values[at], np.float32(0))
        left = np.flatnonzero(~found & (there != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]], found[left[hit]] = self.values[at[hit]], True
            go = ~hit & (there != -1)
            left, at = left[go], at[go]
        return out, found


class Model:
    """Log-likelihood differences of expressions, of what a history leaves to the backoff, and the curve."""

    def __init__(self, seen: Table, history: Table, weight: float = 1.0, base: float = 0.0) -> None:
        self.seen, self.history, self.weight, self.base = seen, history, weight, base

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What is broadcast: plain arrays, as executors may lack this package."""
        return self.seen.keys, self.seen.values, self.history.keys, self.history.values

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, ...], weight: float = 1.0, base: float = 0.0) -> Model:
        return cls(Table.of(*arrays[:2]), Table.of(*arrays[2:]), weight, base)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Mean evidence of the words of each text, 0 without words."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        key, owner = expressions(texts)
        if len(key):
            value, found = self.seen.find(key)
            rest = np.flatnonzero(~found)
            value[rest] = self.history.find(key[rest] >> np.int64(8))[0]
            starts = np.flatnonzero((key >> np.int64(8)) == _BLANK)
            word = np.add.reduceat(value.astype(np.float64), starts)
            total = np.bincount(owner[starts], np.maximum(word - MARGIN, 0), len(texts))
            n = np.bincount(owner[starts], minlength=len(texts))
        return total / np.maximum(n, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.weight * np.log(self.evidence(texts) + FLOOR), -30, 30)))


def _tables(counts: DataFrame) -> tuple[Table, Table]:
    """The two tables of a model, from distinct expressions (key, t, o).

    The sums here are by expression, history or last three bytes; only expressions and histories with
    evidence, bounded by ``LABELLED``, and the counts of the 256 bytes reach the driver.
    """
    last = F.col("key").bitwiseAND(0xFFFFFF)
    history = F.shiftright("key", 8)
    shared = counts.groupBy(last.alias("three")).agg(F.count("*").alias("n3"))
    shared = shared.withColumn("two", F.shiftright("three", 8))
    after = shared.groupBy(F.col("two").alias("two_")).agg(
        F.sum("n3").alias("n2"), F.sum(F.least(F.col("n3"), F.lit(SHARED_DISCOUNT))).alias("left2")
    )
    ends = {r["byte"]: r["n"] for r in shared.groupBy(F.col("three").bitwiseAND(255).alias("byte")).agg(F.count("*").alias("n")).collect()}
    single = np.array([ends.get(i, 0) + 0.1 for i in range(256)])
    single /= single.sum()

    own = counts.filter("t > 0 or o > 0").select("key", "t", "o", history.alias("h"))
    kept = lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    by = own.groupBy("h").agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), F.sum(kept("t")).alias("dt"), F.sum(kept("o")).alias("do"))
    by = by.filter("dt < nt or do < no")
    found = by.toArrow()
    nt, no, dt, do = (found.column(c).to_numpy().astype(float) for c in ("nt", "no", "dt", "do"))
    left = lambda d, n: np.where(n > 0, d / np.maximum(n, 1), 1.0)
    histories = Table(found.column("h").to_numpy(), np.log(left(dt, nt) / left(do, no)))

    plain = own.filter(f"t > {DISCOUNT} or o > {DISCOUNT}").withColumn("three_", last)
    plain = plain.join(by.withColumnRenamed("h", "h_"), F.col("h") == F.col("h_"))
    plain = plain.join(shared, F.col("three_") == F.col("three")).join(after, F.col("two") == F.col("two_"))
    found = plain.select("key", "t", "o", "nt", "no", "dt", "do", "n3", "n2", "left2").toArrow()
    key, t, o, nt, no, dt, do, n3, n2, left2 = (found.column(c).to_numpy() for c in found.column_names)
    backoff = (np.maximum(n3 - SHARED_DISCOUNT, 0) + left2 * single[key & 255]) / np.maximum(n2, 1)
    chance = lambda c, n, d: np.maximum(c - DISCOUNT, 0) / np.maximum(n, 1) + left(d, n) * backoff
    return Table(key, np.log(chance(t, nt, dt) / chance(o, no, do))), histories


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and base of the logistic curve through logarithms of evidence x and labels y; without both labels, one through the middle of what evidence can be."""
    if not y.any() or y.all():
        return 1.0, -np.log(0.02 + FLOOR)
    a = np.stack([x - x.mean(), np.ones(len(x))], 1)
    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        gradient = a.T @ (p - y) + np.array([1e-1, 0]) * v
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-1, 1e-6])
        step = np.clip(np.linalg.solve(curve, gradient), -2, 2)
        v -= step
        if abs(step).max() < 1e-8:
            break
    weight = max(float(v[0]), 1e-2)
    return weight, float(v[1]) - weight * float(x.mean())


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labels whose id isn't held out. The shared counts cover all documents."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(part_of(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, known.count())
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, LABELLED / n) * (1 << 30))
    known = known.filter(picked).select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).alias("__toxic"))
    marked = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"), "left")
    calibrates = part_of(F.col("doc_id")) == 4
    counted = marked.select("text", F.when(~calibrates, F.col("__toxic")).alias("label"))
    counted = counted.mapInArrow(_counted, "key bigint, t bigint, o bigint")
    counted = materialize(counted.groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "expressions")
    model = Model(*_tables(counted))
    release(counted)
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model.of(shared.value)
        for batch in batches:
            texts = texts_of(batch)
            found = [ready.evidence(texts[a:b]) for a, b in chunks(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0), *found])), batch.column(1)], names=["x", "y"])

    held = marked.filter(calibrates & F.col("__toxic").isNotNull()).select("text", F.col("__toxic").alias("y"))
    rows = held.mapInArrow(evidence, "x double, y boolean").toArrow()
    model.weight, model.base = _calibrate(np.log(rows.column("x").to_numpy() + FLOOR), rows.column("y").to_numpy().astype(bool))
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    The score is the text's alone; null and empty texts have that of no evidence. Labels count where toxic
    isn't null; of several for an id the highest does. Without labels of both kinds, scores say nothing. Repeated
    rows stay; other columns are dropped; an empty table gives an empty result.
    """
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.arrays(), model.weight, model.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model.of(*shared.value)
        for batch in batches:
            texts = texts_of(batch)
            found = np.concatenate([np.zeros(0), *(ready.scores(texts[a:b]) for a, b in chunks(texts))])
            yield with_columns(batch.select(["doc_id"]), {"score": found})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (part_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
