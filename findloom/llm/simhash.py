"""SimHash near-duplicates with pigeonring filtering.

64 bits are cut into a ring of 5 segments. Where two fingerprints differ in at most 2 bits, there is a
segment from which each chain of 1 to 5 consecutive segments differs in at most 2/5 of a bit for each
segment: nothing over two segments, one bit over three or four. So candidates share two consecutive
segments (a join key of 25 or 26 bits), and the longer chains are checked before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize
from .kernels import texts_of, with_columns

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Buckets of more fingerprints than this are linked through midpoints instead of pairs.
PAIRED = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text: a bit is 1 if set in over half of its shingles' hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[SHINGLE - 1 :] or [len(joined)]
    take = xxhash.xxh64_intdigest
    hashes = np.array([take(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in texts_of(batch)], np.uint64).view(np.int64)
        at = batch.schema.get_field_index("text")
        kept = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[n for n in batch.schema.names if n != "text"])
        yield with_columns(kept, {"__print": found})


def _bits(value: Column, k: int) -> Column:
    """Segment k (of the ring) of a 64-bit number, in place."""
    low, n = SEGMENTS[k % len(SEGMENTS)]
    mask = ((1 << n) - 1) << low
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within 2 bits of each other.

    All pairs in a small bucket are checked. In a bucket of over ``PAIRED`` fingerprints, each puts
    itself at every number within 1 bit that keeps the bucket's key; fingerprints are within 2 bits
    just if they meet at such a number, where at most 65 can, and the least is linked to the others.
    So a bucket's cost is linear in its size, and no link is lost.
    """
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), _bits(fp, k).bitwiseOR(_bits(fp, k + 1)).alias("key")) for k in range(5)])
    keyed = prints.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.key")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes, ["k", "key"]), "buckets")

    small = shared.filter(F.col("n") <= PAIRED)
    pairs = small.select("k", "key", F.col("fp").alias("a")).join(small.select("k", "key", F.col("fp").alias("b")), ["k", "key"])
    pairs = pairs.filter("a < b").withColumn("d", F.col("a").bitwiseXOR(F.col("b")))
    chain = F.lit(False)
    for k in range(5):
        third, fourth = F.bit_count(_bits(F.col("d"), k + 2)), F.bit_count(_bits(F.col("d"), k + 3))
        chain = chain | ((F.col("k") == k) & (third <= 1) & (third + fourth <= 1))
    pairs = pairs.filter(chain).filter(F.bit_count("d") <= DISTANCE).select("a", "b")

    flips = [F.lit(0).cast("bigint")] + [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint") for i in range(64)]
    free = lambda k: [i for j in (2, 3, 4) for i in range(SEGMENTS[(k + j) % 5][0], sum(SEGMENTS[(k + j) % 5]))]
    spots = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in range(5):
        spots = spots.when(F.col("k") == k, F.array(*[fp.bitwiseXOR(flips[0])], *[fp.bitwiseXOR(flips[i + 1]) for i in free(k)]))
    met = shared.filter(F.col("n") > PAIRED).select("fp", "k", F.explode(spots).alias("spot"))
    met = met.groupBy("k", "spot").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each document; ``docs`` needs doc_id and text.

    Documents are linked where fingerprints differ in 2 bits at most; component_id is the smallest
    doc_id that links reach. Texts without words, null ones too, have fingerprint zero and are linked
    like others. A null doc_id counts in no minimum; where a component has no other, component_id is
    null. Repeated rows stay. Equal fingerprints are merged by partial sums before any link is sought,
    so a group of copies costs one fingerprint. Empty input gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType
    found = docs.select("doc_id", "text").mapInArrow(
        _prints, T.StructType([T.StructField("doc_id", kind), T.StructField("__print", T.LongType())])
    )
    found = materialize(found.withColumnRenamed("__print", "fp"), "prints")
    prints = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(prints.select("fp")))
    rooted = prints.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    moved = rooted.join(least, "root").select(F.col("fp").alias("__fp"), "component")
    all_prints = prints.join(moved, F.col("fp") == F.col("__fp"), "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "least").alias("component_id")
    )
    return found.join(all_prints, F.col("fp") == F.col("__fp"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component, the row of the smallest doc_id.

    Of rows that share that doc_id, the one with the least hash stays. Rows with a null doc_id stay.
    Rows of one id are merged by partial minima, so any number of them is safe. Columns stay as they are, whatever
    their names; an empty table gives an empty result.
    """
    known = docs.filter("doc_id is not null")
    first = near_duplicates(known.select("doc_id", "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = known.select(F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("hash"), F.struct(*columns).alias("held"))
    kept = held.join(first, F.col("id") == F.col("first"), "left_semi")
    once = kept.groupBy("id").agg(F.min_by("held", "hash").alias("held"))
    return once.select("held.*").unionAll(docs.filter("doc_id is null"))
