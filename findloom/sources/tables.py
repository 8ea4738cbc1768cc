"""Native databases: folders of Parquet files, one folder below for each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.operators.index import ORDER, assign_blocks, postings
from findloom.schemas import INDEX, KINDS, OPTIONS, PACKAGES


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def native_kind(spark: SparkSession, path: str) -> str | None:
    """The kind of a database folder; None for anything else."""
    return next((k for k in KINDS if exists(spark, f"{path}/kind={k}")), None)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_options(options: DataFrame, path: str) -> None:
    _write(options.orderBy("name"), f"{path}/kind={OPTIONS}")


def write_packages(records: DataFrame, path: str) -> None:
    _write(records.orderBy("path"), f"{path}/kind={PACKAGES}")


def write_index(records: DataFrame, path: str) -> None:
    """Records in blocks, and the trigram tables made from the records as written."""
    spark, base = records.sparkSession, f"{path}/kind={INDEX}"
    placed = assign_blocks(records)
    _write(placed.repartitionByRange("block_id").sortWithinPartitions("block_id", *ORDER), f"{base}/records")
    trigrams, posted = postings(spark.read.parquet(f"{base}/records"))
    _write(trigrams.repartitionByRange("trigram").sortWithinPartitions("trigram"), f"{base}/trigrams")
    _write(posted.repartitionByRange("trigram", "block_id").sortWithinPartitions("trigram", "block_id"), f"{base}/postings")


def read_native(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/kind={kind}" + ("/records" if kind == INDEX else ""))


def read_index_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    base = f"{path}/kind={INDEX}"
    return spark.read.parquet(f"{base}/trigrams"), spark.read.parquet(f"{base}/postings")


def count(df: DataFrame) -> int:
    return df.agg(F.count("*")).head()[0]
