"""What several operators share: tables, shared folders, hot-group-safe components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark removes a query's shuffle files as soon as it has ended, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, the context's checkpoint folder; in local tests a temporary one that becomes it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="findloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions in this block leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: the rows survive the loss of any executor and are computed once. The shuffle files
    that led to them go at once. ``release`` removes the files; ``release_all`` those of all operators, once no
    result is needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/findloom/{tag}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._findloom_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    _remove(df.sparkSession, df._findloom_path)


def release_all(spark: SparkSession) -> None:
    """Remove every table that operators have written to the shared folder."""
    _remove(spark, f"{shared_dir(spark)}/findloom")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: distributed union-find by alternating stars.

    ``edges`` has columns ``a`` and ``b`` of one orderable type without nulls. Returns ``node`` and
    ``root`` (the least node of its component) for every node of an edge between two nodes; no such edge
    gives no rows. A node with very many edges is safe: minima are aggregated before the shuffle and
    joined back by joins that Spark can split. Each round is written to the shared folder; the search
    ends when every node has one link, to a node that has none.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(ends.distinct(), "links")
    while True:
        more = links.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        chained = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
        with shuffles_removed(links.sparkSession):
            settled = more.isEmpty() and chained.isEmpty()
        if settled:
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        small = small.select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).filter("a <> b")
        after = materialize(small.distinct(), "links")
        release(links)
        links = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
