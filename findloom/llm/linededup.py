"""Fuzzy line dedup by MinHash.

Distinct lines get MinHash signatures of their character shingles; lines that share a band are
candidates, checked by exact Jaccard likeness; links are joined by distributed union-find, and of each
component the earliest line stays. Shingles are the ``WIDTH`` characters from each position on, so that every
character of a line is in some; a shorter line is its own one shingle.

A shingle is hashed once, to h; its hash by permutation i is h times an odd constant, and the least of these
over a line is the line's i-th MinHash. A band's bucket of up to ``SMALL`` lines gives its pairs of whose 32 bits, one
of a MinHash each, ``AGREE`` or more agree, as short shingles meet in unlike lines too. The bits are the upper half of
the number that stands for a line, so that they need no room of their own. In larger
ones, lines are compared with a hub, the line most like the others; lines linked to one hub need no link
among themselves. Other pairs of a bucket are taken each in buckets of up to ``DIRECT`` lines, where parities of their
shingles leave room for ``THRESHOLD`` (``_reach``); in larger ones those that can reach it are found by the rarest
shingles of each line. Neither loses a pair. So no group of alike lines is compared pair by pair. Before texts are compared, two bits of 64 MinHashes must tell few of them apart (``APART``).

Bands are dealt ``PASS`` at a time, and texts are fetched of lines that have a candidate only: what lies on disk at
once is the lines and a third of the bands.

Lines are cut and signed in numpy, batch by batch: with SQL functions alone, signatures of
shingles at every position took more than the check tool's whole budget (README, "Check tool"). All joins and groups are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release, shuffles_removed
from .kernels import chunks, mix, texts_of

WIDTH, THRESHOLD = 5, 0.8
#: At a likeness of 0.8, fifteen bands of five miss 0.3 % of pairs; at 0.9, two in a million.
BANDS, ROWS = 15, 5
#: Of 32 bits, one of a MinHash each, so many agree; of pairs at 0.8, 8 in 10,000 have fewer.
AGREE = 23
#: Of 64 MinHashes, two bits each, so many may differ; of pairs at 0.8, 1 in 100,000 differ in more.
APART = 23
#: Lines of a bucket that is compared pair by pair.
SMALL = 16
#: Lines of a bucket whose lines of different labels are compared pair by pair, by the bits of their MinHashes and parities.
DIRECT = 4096
#: Numbers of 64 bits, each the parity of the shingles that a hash deals to it.
PARITIES = 16
#: Bands that are dealt at once.
PASS = 5
#: Rows of one or two numbers that are broadcast, at most: 16 MB.
BROADCAST = 1_000_000
#: Documents that lose lines, whose line numbers are broadcast, at most: 10 to 20 MB. Beyond, texts are shuffled for them.
GONE = 250_000
#: A line that occurs more often than this is looked up by a broadcast, as all its places would meet in one task.
COMMON = 10_000
#: Bytes of text that are signed at once, and lines that a task remembers so as to sign them once.
CHUNK, REMEMBERED = 1 << 17, 1 << 20
#: Columns with the hash of each band.
_KEYS = [f"key{i}" for i in range(BANDS)]
_BLANK = " \t\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"


def _factors() -> np.ndarray:
    """The odd constants of the permutations."""
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def _sign(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines ``codes[start:end]`` (code points): the hash of each band, 32 bits, one of a MinHash each, and two
    numbers of one bit each of 64 MinHashes."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(WIDTH, np.uint32)])
    h = np.zeros(n + 1, np.uint32)
    for k in range(WIDTH):
        h *= np.uint32(0x9E3779B1)
        h += padded[k : n + 1 + k]
    for s, e in zip(start[end - start < WIDTH].tolist(), end[end - start < WIDTH].tolist(), strict=True):
        h[s] = xxhash.xxh32_intdigest(codes[s:e].tobytes())
    counts = np.maximum(end - start - WIDTH + 1, 1)
    edges = np.zeros(n + 2, np.int8)
    edges[start] += 1
    np.subtract.at(edges, start + counts, 1)
    h = h[np.cumsum(edges[: n + 1], dtype=np.int8) > 0]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    least, spare = np.empty((BANDS * ROWS, len(start)), np.uint32), np.empty_like(h)
    for i, factor in enumerate(_factors()):
        np.minimum.reduceat(np.multiply(h, factor, out=spare), starts, out=least[i])
    least = least.reshape(BANDS, ROWS, -1).astype(np.uint64)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(start), 1)
    for row in range(ROWS):
        keys = mix((keys ^ least[:, row]) * np.uint64(0x9E3779B97F4A7C15))
    single = mix(least[:, :3].transpose(1, 0, 2).reshape(3 * BANDS, -1)[:32] * np.uint64(0x94D049BB133111EB)) & np.uint64(1)
    bits = np.bitwise_or.reduce(single << np.arange(32, dtype=np.uint64)[:, None], 0)
    pair = mix(least.reshape(BANDS * ROWS, -1)[:64] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(62)
    at = np.arange(64, dtype=np.uint64)[:, None]
    marks = np.stack([np.bitwise_or.reduce((pair >> np.uint64(i) & np.uint64(1)) << at, 0) for i in (0, 1)])
    return np.ascontiguousarray(keys.T).view(np.int64), bits, marks.view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with a word of documents (doc_id, row, text), as ``_lines`` has them."""
    known: dict[int, int] = {}  # k1 by k2
    for batch in batches:
        texts = texts_of(batch)
        for a, b in chunks(texts, CHUNK):
            joined = b"\n".join(texts[a:b]).decode("utf-8", "replace")
            lines = joined.split("\n")
            per = np.fromiter((x.count(b"\n") + 1 for x in texts[a:b]), np.int64, b - a)
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            at = np.array([i for i, x in enumerate(lines) if x.strip(_BLANK)], np.int64)
            if not len(at):
                continue
            owner = np.repeat(np.arange(b - a), per)[at]
            number = (np.arange(len(lines)) - np.repeat(np.cumsum(per) - per, per))[at]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lines[i].encode()) for i in at), "<u8").reshape(-1, 2)
            k2 = names[:, 0].view("<i8").tolist()
            if len(known) > REMEMBERED:
                known.clear()
            first: dict[int, int] = {}
            for i, k in enumerate(k2):
                if k not in known:
                    first.setdefault(k, i)
            new = np.zeros(len(at), bool)
            new[list(first.values())] = True
            keys, marks = np.zeros((0, BANDS), np.int64), np.zeros((2, 0), np.int64)
            if first:
                codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                end = (np.cumsum(sizes + 1) - 1)[at[new]]
                keys, bits, marks = _sign(codes, end - sizes[at[new]], end)
                known.update(zip(first, ((bits << np.uint64(32)) | (names[new, 1] >> np.uint64(32))).view(np.int64).tolist(), strict=True))
            spread = np.zeros((2 + BANDS, len(at)), np.int64)
            spread[:, new] = np.concatenate([marks, keys.T])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner + a)),
                    batch.column(1).take(pa.array(owner + a)),
                    pa.array(number.astype(np.int32)),
                    pa.array([known[k] for k in k2], pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.array([lines[i] if x else None for i, x in zip(at.tolist(), new.tolist(), strict=True)], pa.string()),
                    *[pa.array(x, mask=~new) for x in spread],
                ],
                names=["doc_id", "row", "line_no", "k1", "k2", "line", "s1", "s2", *_KEYS],
            )


def _row() -> Column:
    """What tells a document from others of its id or of null ids: a hash of both id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """All lines with a word, written: doc_id, row (see ``_row``), line_no (from 0), k1 and k2, which stand for the
    text by 32 bits of MinHashes and 96 of a hash, line, s1 and s2, bits of 64 MinHashes, and key0, key1, ..., the hash of
    each band. From line on, they stand where a task meets the line first and are null elsewhere."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, line_no int, k1 bigint, k2 bigint, line string, s1 bigint, s2 bigint, " + ", ".join(f"{x} bigint" for x in _KEYS)
    return materialize(docs.select("doc_id", _row().alias("row"), "text").mapInArrow(_cut, schema), "lines")


def _agree(a: Column, b: Column) -> Column:
    """Whether ``AGREE`` or more of the 32 bits of MinHashes of two lines agree."""
    return F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), 32)) <= 32 - AGREE


def _near(a: str, b: str) -> Column:
    """Whether the two bits of at most ``APART`` of 64 MinHashes tell the lines with marks s1 and s2 of ``a`` and ``b`` apart."""
    differ = lambda s: F.col(f"{s}{a}").bitwiseXOR(F.col(f"{s}{b}"))
    return F.bit_count(differ("s1").bitwiseOR(differ("s2"))) <= APART


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different lines, the lesser first, each once."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _if_few(table: DataFrame) -> DataFrame:
    """A written table of one or two numbers a row, broadcast if it has up to ``BROADCAST`` rows; else its join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, node (the line's name among components) and line, of the lines in ``wanted`` (k1, each once)."""
    texts = lines.filter("line is not null").select("k1", "k2", "line").join(_if_few(wanted), "k1", "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.any_value("line").alias("line"))
    return texts.select("k1", F.concat_ws(":", F.hex("k1"), F.hex("k2")).alias("node"), "line")


def _shingles(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line, each once, in order, as 64-bit numbers."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    whole = np.zeros(max(0, len(codes) - WIDTH + 1), np.uint64)
    for k, factor in enumerate(mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)):
        whole += codes[k : len(whole) + k] * factor
    found, end = [], 0
    for line in lines:
        start, end = end, end + len(line)
        if end - start < WIDTH:
            found.append(np.array([xxhash.xxh3_64_intdigest(line.encode())], np.uint64))
            continue
        own = np.sort(whole[start : end - WIDTH + 1])
        fresh = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        found.append(own[fresh])
    return found


def _parities(texts: DataFrame) -> DataFrame:
    """Of each line of ``texts``: k1, n (its shingles) and x0, x1, ..., ``PARITIES`` numbers of parities.

    A shingle that only one of two lines has turns one bit, so they differ in as many shingles as bits, at least.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).to_pylist()
            sizes, odd = np.zeros(len(lines), np.int32), np.zeros((len(lines), PARITIES), np.int64)
            for i, line in enumerate(lines):
                own = _shingles([line])[0]
                sizes[i] = len(own)
                bits = np.bincount((mix(own) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
                odd[i] = np.packbits(bits.astype(np.uint8)).view(np.int64)
            arrays = [batch.column(0), pa.array(sizes), *[pa.array(odd[:, i]) for i in range(PARITIES)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "n", *names])

    names = [f"x{i}" for i in range(PARITIES)]
    return texts.select("k1", "line").mapInArrow(count, "k1 bigint, n int, " + ", ".join(f"{x} bigint" for x in names))


def _reach(a: str, b: str) -> Column:
    """Whether the parities of ``a`` and ``b`` leave room for a likeness of ``THRESHOLD``; loses no pair that reaches it."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x{i}{a}").bitwiseXOR(F.col(f"x{i}{b}"))) for i in range(PARITIES)])
    return differ <= (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col(f"n{a}") + F.col(f"n{b}")) + 1e-6


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of lines (a, b, na, nb, la, lb), the rows whose Jaccard likeness is ``THRESHOLD`` or more, without texts."""
    for batch in batches:
        left, right, kept = texts_of(batch, "la"), texts_of(batch, "lb"), []
        for first, last in chunks([x + y for x, y in zip(left, right, strict=True)]):
            at = {x: i for i, x in enumerate(dict.fromkeys(left[first:last] + right[first:last]))}
            sets = _shingles([x.decode("utf-8", "replace") for x in at])
            for i in range(first, last):
                one, other = sets[at[left[i]]], sets[at[right[i]]]
                n, m = len(one), len(other)
                if min(n, m) >= THRESHOLD * max(n, m):
                    both = np.concatenate((one, other))
                    both.sort()
                    common = np.count_nonzero(both[1:] == both[:-1])
                    if common >= THRESHOLD * (n + m - common):
                        kept.append(i)
        yield batch.select([0, 1, 2, 3]).take(pa.array(kept, pa.int64()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose Jaccard likeness is ``THRESHOLD`` or more, with the nodes na and nb.

    Lines are cut into shingles here, as these take many times a line's space.
    """
    side = lambda c: texts.select(F.col("k1").alias(c), F.col("node").alias(f"n{c}"), F.col("line").alias(f"l{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "la", "lb")
    return both.mapInArrow(_alike, "a bigint, b bigint, na string, nb string")


def _tokens(line: str) -> np.ndarray:
    """Hashes of the line's shingles, each once, in order."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(codes.tobytes())], np.uint64).view(np.int64)
    h = np.zeros(len(codes) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        h = mix((h + codes[k : len(h) + k]) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h.view(np.int64))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(np.concatenate([_tokens(x) for x in batch.column(0).to_pylist()] or [np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["token", "df"])


def _ranked(texts: DataFrame) -> DataFrame:
    """Of each line of ``texts``: k1, n (its shingles) and rare, its rarest floor(n / 5) + 1 shingles, the rarest first.

    All lines order shingles alike: those that under a thousandth of the lines have first, by hash, then the others,
    by how many lines have them. So the others, which are broadcast, are a thousand times a line's shingles at most.
    """
    counts = texts.select("line").mapInArrow(_frequencies, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df"))
    with shuffles_removed(texts.sparkSession):
        often = counts.filter(F.col("df") > max(2, texts.count() // 1000)).toArrow()
    order = np.argsort(often.column("token").to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast((often.column("token").to_numpy()[order], often.column("df").to_numpy()[order]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequency = shared.value
        for batch in batches:
            sizes, rare = [], []
            for line in batch.column(1).to_pylist():
                tokens = _tokens(line)
                at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                df = np.where(known[at] == tokens, frequency[at], 0) if len(known) else np.zeros(len(tokens), np.int64)
                sizes.append(len(tokens))
                rare.append(tokens[np.argsort(df, kind="stable")[: int(len(tokens) * (1 - THRESHOLD) + 1e-9) + 1]])
            arrays = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "n", "rare"])

    return texts.select("k1", "line").mapInArrow(rank, "k1 bigint, n int, rare array<bigint>")


def _hub_links(members: DataFrame, texts: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links (a, b) of large buckets' lines (key, k1, s1, s2) to the lines most like all others.

    In rounds: of a bucket's lines that no hub was linked to, the one that shares the most buckets with others is the
    next hub, and is compared with all the bucket's lines. A bucket leaves when its hub finds under an eighth of those
    that are left, or ``SMALL`` are left.
    """
    rest = members
    links = rest.select(F.lit("").alias("a"), F.lit("").alias("b")).limit(0)
    done: list[DataFrame] = []
    while True:
        counts = rest.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("m"))
        crowded = materialize(rest.join(counts.filter(F.col("m") > SMALL), F.col("key") == F.col("key_")).drop("key_"), "crowded")
        for table in done:  # of the round before
            release(table)
        if crowded.isEmpty():
            release(crowded)
            return links
        met = crowded.groupBy(F.col("k1").alias("met")).agg(F.sum("m").alias("x"))
        hubs = crowded.join(met, F.col("k1") == F.col("met"))
        hubs = hubs.groupBy("key", "m").agg(F.max_by(F.struct("k1", "s1", "s2"), F.struct("x", "k1")).alias("hub"))
        hubs = materialize(hubs.select("key", "m", F.col("hub.k1").alias("a"), F.col("hub.s1").alias("s1a"), F.col("hub.s2").alias("s2a")), "hubs")
        done = [crowded, hubs]
        tried = members.select("key", F.col("k1").alias("b"), F.col("s1").alias("s1b"), F.col("s2").alias("s2b")).join(hubs, "key")
        found = keep(_verified(tried.filter(_near("a", "b")).select("a", "b").distinct(), texts), "alike")
        links = links.unionAll(found.filter("a <> b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
        near = found.select(F.col("a").alias("hub"), F.col("b").alias("k1"))
        left = crowded.join(hubs.select("key", F.col("a").alias("hub")), "key").join(near, ["hub", "k1"], "left_anti").drop("hub")
        after = left.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("m_"))
        useful = F.col("m") - F.col("m_") >= F.col("m") / 8
        rest = left.join(after, F.col("key") == F.col("key_")).filter(useful).select("key", "k1", "s1", "s2")


def _across(members: DataFrame, texts: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs of different labels, in buckets (key, k1, s1, s2, label), that can reach ``THRESHOLD``.

    Where a bucket's lines mostly have one label, only those of the others are compared with all. A bucket of up to
    ``DIRECT`` lines gives its pairs that are near by their marks and in reach by their parities, a pair only in the first
    bucket that both are in. In larger ones, pairs need a shingle in common: of two
    lines that are alike, one of the rarest floor(n / 5) + 1 of the n shingles of either is one of the
    other's, in any order of shingles. The first such shingle that two lines share, at positions p and q, is
    followed by at most the lesser of n - p and m - q more; if all those together are too few, the pair is left
    out. Where a shingle's lines mostly have one label, only those of the others are joined with all.
    """
    by = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    by = by.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("parts"))
    mixed = keep(members.join(by.filter("parts > 1").drop("parts"), "key"), "mixed")
    few = mixed.filter(F.col("m") <= DIRECT)
    odd = keep(_parities(texts.join(few.select("k1").distinct(), "k1", "left_semi")), "parities")
    held = few.groupBy(F.col("k1").alias("of")).agg(F.collect_set("key").alias("held"))  # a key a band at most
    few = few.join(held, F.col("k1") == F.col("of")).withColumn("before", F.filter("held", lambda x: x < F.col("key"))).join(odd, "k1")
    names = [("k1", ""), ("label", "l"), *[(x, x) for x in ("s1", "s2", "before", "n", *[f"x{i}" for i in range(PARITIES)])]]
    side = lambda c: [F.col(x).alias(f"{y}{c}") for x, y in names]
    left, right = few.filter("label <> main").select("key", "main", *side("a")), few.select("key", *side("b"))
    once = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b"))) & ~F.arrays_overlap("beforea", "beforeb")
    pairs = _ordered(left.join(right, "key").filter(_near("a", "b") & _reach("a", "b") & once).select("a", "b"))
    many = mixed.filter(F.col("m") > DIRECT).select("key", "k1", "label")
    if many.isEmpty():
        return pairs
    ranked = keep(_ranked(keep(texts.join(many.select("k1").distinct(), "k1", "left_semi"), "rankedtexts")), "ranked")
    rare = many.join(ranked, "k1").select("key", "k1", "label", "n", F.posexplode("rare").alias("p", "token"))
    by = rare.groupBy("key", "token", "label").agg(F.count("*").alias("c"))
    by = by.groupBy("key", "token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    shared = keep(rare.join(by, ["key", "token"]), "shared")
    side = lambda c: [F.col("k1").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}")]
    left, right = shared.filter("label <> main").select("key", "token", *side("a")), shared.select("key", "token", *side("b"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # shingles in common, at most
    near = (most >= THRESHOLD / (1 + THRESHOLD) * (F.col("na") + F.col("nb")) - 1e-9) & (F.col("la") != F.col("lb"))
    return _ordered(pairs.unionAll(left.join(right, ["key", "token"]).filter(near).select("a", "b")))


def _candidates(lines: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines that share a bucket of up to ``SMALL``, whose bits agree, and the members (key, k1) of larger
    buckets, ``PASS`` bands after the other."""
    pairs, large = [], []
    for first in range(0, BANDS, PASS):
        # Not filtered by line, as texts would be read for that.
        keyed = lines.filter(F.col(_KEYS[first]).isNotNull()).select("k1", F.explode(F.array(*_KEYS[first : first + PASS])).alias("key"))
        buckets = keyed.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.count("*").alias("n"))
        # A line that several tasks met is there several times.
        buckets = materialize(buckets.filter((F.col("a") < F.col("b")) & ((F.col("n") > 2) | _agree(F.col("a"), F.col("b")))), "buckets")
        several = materialize(buckets.filter("n > 2").select("key"), "several")
        dealt = materialize(keyed.join(_if_few(several), "key").distinct(), "members")
        sizes = dealt.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"))
        members = dealt.join(sizes, F.col("key") == F.col("of")).drop("of")
        small = members.filter(F.col("n") <= SMALL)
        large.append(keep(members.filter(F.col("n") > SMALL).select("key", "k1"), "large"))
        met = small.select("key", F.col("k1").alias("a")).join(small.select("key", F.col("k1").alias("b")), "key")
        met = met.filter((F.col("a") < F.col("b")) & _agree(F.col("a"), F.col("b"))).select("a", "b")
        pairs.append(keep(_ordered(met.unionAll(buckets.filter("n = 2").select("a", "b"))), "met"))
        for table in (buckets, several, dealt):
            release(table)
    return reduce(DataFrame.unionAll, pairs).distinct(), reduce(DataFrame.unionAll, large)


def _components(lines: DataFrame) -> DataFrame:
    """Components (node, root) of the lines that are like others. Tables written on the way, and ``lines``, are removed as
    soon as nothing reads them."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(materialize(df, tag))
        return made[-1]

    def joined(links: DataFrame) -> DataFrame:
        links = materialize(links, "alllinks")
        for table in made:
            release(table)
        found = connected_components(links)
        release(links)
        return found

    pairs, large = _candidates(lines, keep)
    pairs = keep(pairs, "pairs")
    met = keep(pairs.select(F.explode(F.array("a", "b")).alias("k1")).unionAll(large.select("k1")).distinct(), "met")
    marks = lines.filter("s1 is not null").select("k1", "s1", "s2").join(_if_few(met), "k1", "left_semi")
    marks = keep(marks.groupBy("k1").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2")), "marks")
    mark = lambda c: marks.select(F.col("k1").alias(c), F.col("s1").alias(f"s1{c}"), F.col("s2").alias(f"s2{c}"))
    pairs = keep(pairs.join(mark("a"), "a").join(mark("b"), "b").filter(_near("a", "b")).select("a", "b"), "near")
    large = keep(large.join(marks, "k1").select("key", "k1", "s1", "s2"), "large")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).unionAll(large.select("k1")).distinct()
    texts = keep(_texts(lines, keep(wanted, "wanted")), "texts")
    release(lines)
    if large.isEmpty():
        found = _verified(pairs, texts).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        return joined(found)
    crowd = keep(large.select("k1").distinct(), "crowd")
    own = keep(texts.join(_if_few(crowd), "k1", "left_semi"), "crowdtexts")
    parts = connected_components(_hub_links(large, own, keep))
    named = own.select("k1", "node").join(parts, "node", "left").select("k1", F.xxhash64(F.coalesce("root", "node")).alias("label"))
    found = _verified(pairs.unionAll(_across(large.join(named, "k1"), own, keep)).distinct(), texts).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return joined(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))


def _dropped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc_id, row, line_no, k1, k2 as ``_lines`` has them), and of each document that loses
    lines: id, in_row and gone, their numbers (from 0, by ``\\n``).

    Of the lines of a component, and of equal lines, that of the smallest doc_id, then of the least row and line_no
    is kept; null ids come last. Rows equal in doc_id and text are one document, others are documents of their own.
    Equal lines are merged by partial sums before components are looked up, and very common ones by a broadcast.
    """
    signed = _lines(docs)
    lines = materialize(signed.select("doc_id", "row", "line_no", "k1", "k2"), "spots")
    name = F.split("node", ":")
    number = lambda i: F.conv(F.get(name, F.lit(i)), 16, -10).cast("bigint")
    parts = _components(signed).select(number(0).alias("p1"), number(1).alias("p2"), "root")
    spot = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "line_no")
    distinct = lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(spot).alias("first"))
    distinct = distinct.join(parts, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left").drop("p1", "p2")
    distinct = materialize(distinct.filter("n > 1 or root is not null"), "distinct")
    firsts = distinct.filter("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("first").alias("least"))
    named = distinct.join(firsts, F.col("root") == F.col("of"), "left")
    named = materialize(named.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "n", F.coalesce("least", "first").alias("first")), "kept")
    release(distinct)
    same = (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))
    common = _if_few(materialize(named.filter(F.col("n") > COMMON), "common"))
    placed = lines.join(common, same).unionAll(lines.join(common, same, "left_anti").join(named.filter(F.col("n") <= COMMON), same))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    gone = placed.filter(~kept).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("in_row"))
    return lines, materialize(gone.agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "gone")


def dedup_report(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_lines (lines with a word), n_dropped and dropped, the numbers (from 0, by
    ``\\n``) of the lines that go. Null and empty texts have no lines and empty lists; rows equal in doc_id
    and text share a row, which counts the lines of all; rows of one doc_id with other texts have their own; other
    columns are dropped, whatever their names; empty input gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    lines, gone = _dropped(docs)
    counts = lines.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(F.count("*").alias("n"))
    found = docs.select("doc_id", _row().alias("row")).distinct()
    found = found.join(counts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    found = found.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("in_row")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return found.select("doc_id", n.alias("n_lines"), F.size(gone).cast("bigint").alias("n_dropped"), gone.alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go, and without documents that have no line left.

    Columns stay as they are, whatever their names; n_chars, where there is one, is set anew where lines go.
    Documents that had no line with a word before are kept as they are. Empty input gives an empty result.
    """
    n_lines = F.coalesce(F.regexp_count("text", F.lit(rf"{_WORD}[^\n]*")), F.lit(0))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col("doc_id").alias("own_id"), _row().alias("own_row"), "text", n_lines.alias("n_lines"))
    gone = _dropped(docs.select("doc_id", "text"))[1]
    gone = F.broadcast(gone) if gone.count() <= GONE else gone
    rows = own.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_row") == F.col("in_row")), "left")
    rows = rows.filter(F.col("gone").isNull() | (F.size("gone") < F.col("n_lines")))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    rows = rows.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    fields = {c: F.col("held").getField(c) for c in docs.columns}
    fields["text"] = F.col("left")
    if "n_chars" in fields:
        n_chars = F.length("left").cast(docs.schema["n_chars"].dataType)
        fields["n_chars"] = F.when(F.col("gone").isNull(), fields["n_chars"]).otherwise(n_chars)
    return rows.select(*[x.alias(c) for c, x in fields.items()])
