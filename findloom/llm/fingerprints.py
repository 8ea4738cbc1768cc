"""Document fingerprints from closed syncmers.

A document's words are hashed; a window of ``K`` words is an anchor if the least of its inner hashes,
those of ``S`` words each, stands at either edge. Whether a window is one depends on its own words
alone, so passages shared by two documents have the same anchors wherever they stand. A fingerprint
holds the ``SKETCH`` least distinct anchor hashes, an unbiased sketch of the set of all anchors; likenesses
are those of the whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, S = 5, 2
#: Anchor hashes in a fingerprint, of 16 hexadecimal digits each.
SKETCH = 64
#: Rows of one bucket, in which the next document is sought: a power of 2.
BUCKET_BITS = 12
BUCKET = 1 << BUCKET_BITS
#: Rows of three numbers that are broadcast, at most: one for each bucket.
BROADCAST = 500_000
SPACE = r"[\x20\x09-\x0D]+"


def _hashes(text: Column) -> Column:
    """The hash of each word."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _inner(h: Column) -> Column:
    """The hash of each ``S`` = 2 words."""
    return F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _anchors(m: Column) -> Column:
    """Hashes of the closed syncmers, null where a window isn't one. ``m``: a column of inner hashes.

    The last inner hash is of one word, so there are size - K + 1 windows. A text of 1 to K - 1 words, or
    one in which no window is a syncmer, has its whole sequence as its one anchor; one without words has none.
    """
    n = F.size(m)

    def window(i: Column) -> Column:
        a, b, c, d = (F.get(m, i + j) for j in range(4))
        return F.when(F.least(a, d) <= F.least(b, c), F.xxhash64(a, b, c, d))

    found = F.transform(F.sequence(F.lit(0), n - K), window)
    # A variable of the outer lambda holds the windows, so that they're computed once.
    whole = F.array(F.xxhash64(m))
    some = F.get(F.transform(F.array(found), lambda x: F.when(F.exists(x, lambda h: h.isNotNull()), x).otherwise(whole)), F.lit(0))
    return F.when(n >= K, some).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _set(anchors: Column) -> Column:
    return F.sort_array(F.array_compact(F.array_distinct(anchors)))


def _text(anchors: Column) -> Column:
    """The fingerprint: the least of a sorted set of anchors."""
    return F.array_join(F.transform(F.slice(anchors, 1, SKETCH), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sorted set of all anchors of column ``text`` as array column ``out``. Each step is a projection of its own, so nothing is computed twice."""
    own = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*own, _hashes(F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    df = df.select(*own, _inner(F.col("__h")).alias("__m"))
    df = df.select(*own, _anchors(F.col("__m")).alias("__a"))
    return df.select(*own, _set(F.col("__a")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of anchors, 0 to 1. Two empty ones are alike (1)."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def anchors(docs: DataFrame) -> DataFrame:
    """All anchors (doc_id, position, anchor): position is that of the window's first word, from 0.

    For positional matching: join on anchor, and equal passages give runs of equal differences of
    position. A null text is empty; texts without words give no rows.
    """
    df = docs.select("doc_id", _hashes(F.coalesce("text", F.lit(""))).alias("__h"))
    df = df.select("doc_id", _inner(F.col("__h")).alias("__m"))
    df = df.select("doc_id", F.posexplode(_anchors(F.col("__m"))).alias("position", "anchor"))
    return df.filter("anchor is not null")


def _heads(ids: DataFrame) -> DataFrame:
    """Of buckets of ids (b, id): head, the largest id of each, and behind, the bucket before it by descending ids.

    Behind the last bucket comes the first. Buckets are ordered in groups of ``BUCKET``, and the groups by one
    row each, so no task orders more than that or their number's square root.
    """
    heads = ids.groupBy("b").agg(F.max("id").alias("head")).withColumn("bb", F.shiftright("b", BUCKET_BITS))
    heads = heads.withColumn("behind", F.lag("b").over(Window.partitionBy("bb").orderBy(F.col("b").desc())))
    tops = heads.groupBy("bb").agg(F.max("b").alias("top"), F.min("b").alias("last"))
    end = F.first("last").over(Window.orderBy("bb"))
    tops = tops.select("top", F.coalesce(F.lag("last").over(Window.orderBy(F.col("bb").desc())), end).alias("before"))
    heads = heads.join(tops, F.col("b") == F.col("top"), "left")
    return heads.select(F.col("b").alias("__b"), F.col("head").alias("__head"), F.coalesce("behind", "before").alias("__behind"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and anchors, and next_text and next_anchors: those of the next document by descending
    doc_id (a whole number); after the last comes the first.

    Ids are cut into even ranges of about ``BUCKET`` rows each, and a range's rows are ordered together,
    with the first row of the range that follows behind them; which one that is, is found on ids alone. Texts
    are shuffled once. Null ids come last; rows of one id are ordered by their text.
    """
    number = F.col("doc_id").cast("bigint")
    low, high, n = docs.agg(F.min(number), F.max(number), F.count("*")).head()
    width = max(1, ((high or 0) - (low or 0) + 1) * BUCKET // max(n, 1))
    bucket = F.coalesce(F.expr(f"(cast(doc_id AS bigint) - {low or 0}L) div {width}L"), F.lit(-1).cast("bigint"))
    texts = docs.select("doc_id", "text", bucket.alias("__at"))
    heads = materialize(_heads(texts.select(F.col("__at").alias("b"), F.col("doc_id").alias("id"))), "heads")
    few = heads.count() <= BROADCAST
    first = (F.col("__at") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__head"))
    behind = texts.join(F.broadcast(heads) if few else heads, first)
    every = texts.select("__at", F.lit(0).alias("__behind"), "doc_id", "text").unionAll(
        behind.select(F.col("__behind").alias("__at"), F.lit(1).alias("__behind"), "doc_id", "text")
    )
    every = with_anchors(every.repartition("__at"), "text", "anchors")
    order = Window.partitionBy("__at").orderBy("__behind", F.col("doc_id").desc_nulls_last(), "text")
    ahead = every.withColumn("__next", F.lead(F.struct("text", "anchors")).over(order)).filter("__behind = 0")
    return ahead.select("doc_id", "text", "anchors", F.col("__next.text").alias("next_text"), F.col("__next.anchors").alias("next_anchors"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint: the least anchor hashes of the whole text, empty if it has no words."""
    return with_anchors(docs.select("doc_id", "text"), "text", "__s").select("doc_id", _text(F.col("__s")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and the likeness of all their anchors.

    The edited text: the last floor(n / 2) of a text's n code points give way to as many of the first
    ones of the next document, or all of them. Null texts are empty, empty ones have an empty
    fingerprint; a single document is its own next one. Repeated rows are documents of their own;
    other columns are dropped; empty input gives an empty result. Native throughout; each text is
    shuffled once.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(texts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = both.withColumns({"n_chars": n.cast("bigint"), "edited": edited})
    both = with_anchors(both.select("doc_id", "n_chars", "anchors", "next_anchors", "edited"), "edited", "edited_anchors")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _text(F.col("anchors")).alias("fingerprint"),
        _text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
