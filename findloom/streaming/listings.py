"""Listings that arrive as files, merged into a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findloom.operators.merge import merge_records
from findloom.schemas import FILE_KEY
from findloom.sources.crawl import parse_listings


def stream_listings(spark: SparkSession, folder: str, raw: str, checkpoint: str) -> StreamingQuery:
    """Append the entries of each new ``<hash>.ls`` file in ``folder`` to the Parquet table ``raw``, then stop.

    Each file counts once, across restarts too: its batch replaces what a broken try of it has written.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ls$", 1)
    texts = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.ls").text(folder)

    def add(batch: DataFrame, number: int) -> None:
        parse_listings(batch).write.mode("overwrite").parquet(f"{raw}/batch={number}")

    writer = texts.select(name.alias("hash"), "value").writeStream.foreachBatch(add)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, raw: str, labels: DataFrame) -> DataFrame:
    """File records of the table, owned by the labels (hash, label) of their hashes."""
    files = spark.read.parquet(raw).filter("kind <> 'd'").join(labels, "hash")
    return merge_records(files.withColumn("packages", F.array("label")), FILE_KEY)
