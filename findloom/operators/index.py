"""The trigram block index: blocks of ordered records, and which blocks have a trigram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.functions.lines import encode_file
from findloom.functions.text import byte_trigrams, query_trigrams
from findloom.operators.ranges import global_index

#: Bytes of records in a block.
BLOCK_BYTES = 128 * 1024
#: Block ids that a search puts into its filter; more are joined.
LISTED = 10_000
ORDER = ["path", "kind", "target", "size", "executable"]


def assign_blocks(records: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add block_id: records in order, a new block each ``block_bytes`` of their lines."""
    sized = records.withColumn("__bytes", F.octet_length(encode_file()).cast("bigint") + 1)
    placed = global_index(sized, ORDER, "__before", add="__bytes")
    return placed.withColumn("block_id", F.floor(F.col("__before") / block_bytes).cast("bigint")).drop("__bytes", "__before")


def postings(records: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """For records with block_id: trigrams (trigram, doc_freq, skipped) and postings (trigram, block_id).

    A trigram of more than an eighth of the blocks (and of more than one) is skipped: it's known, but has no postings.
    """
    pairs = records.select("block_id", F.explode(byte_trigrams(F.col(key))).alias("trigram")).distinct()
    blocks = records.agg(F.count_distinct("block_id").alias("__blocks"))
    most = F.greatest(F.lit(1), F.floor(F.col("__blocks") / 8))
    stats = pairs.groupBy("trigram").agg(F.count("*").alias("doc_freq")).crossJoin(F.broadcast(blocks))  # one row: the number of blocks
    stats = stats.select("trigram", "doc_freq", (F.col("doc_freq") > most).alias("skipped"))
    return stats, pairs.join(stats.filter("not skipped").select("trigram"), "trigram").select("trigram", "block_id")


def candidate_blocks(trigrams: DataFrame, posted: DataFrame, query: str) -> DataFrame | list[int] | None:
    """Blocks that can hold a query: None for all, a list of few, or a DataFrame (block_id) of many.

    Short queries, and those whose trigrams are all skipped, can be anywhere; an unknown trigram is nowhere.
    The driver sees a row for each trigram of the query, and ``LISTED`` block ids at most.
    """
    wanted = query_trigrams(query)
    if not wanted:
        return None
    known = trigrams.filter(F.col("trigram").isin(wanted)).collect()
    if len(known) < len(wanted):
        return []
    useful = [r for r in known if not r["skipped"]]
    if not useful:
        return None
    lists = posted.filter(F.col("trigram").isin([r["trigram"] for r in useful]))
    common = lists.groupBy("block_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(useful)).select("block_id")
    if min(r["doc_freq"] for r in useful) <= LISTED:
        return sorted(r["block_id"] for r in common.collect())
    return common


def search_index(records: DataFrame, trigrams: DataFrame, posted: DataFrame, query: str, key: str = "path") -> DataFrame:
    """Records whose key holds the query literally; blocks that can't are not read."""
    blocks = candidate_blocks(trigrams, posted, query)
    if isinstance(blocks, list):
        records = records.filter(F.col("block_id").isin(blocks) if blocks else F.lit(False))
    elif blocks is not None:
        records = records.join(blocks, "block_id", "left_semi")
    return records.filter(F.contains(key, F.lit(query)))
