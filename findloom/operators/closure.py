"""Transitive references: a breadth-first search from seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import attr_label, transitive_label
from findloom.sources.shared import shared_dir

#: Rounds after which what has been visited is written as one table.
FOLD = 8
#: Nodes that are broadcast at most; more are joined by sorting.
BROADCAST = 20_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: survives lost executors and cuts the plan."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def _sized(nodes: DataFrame, count: int) -> DataFrame:
    """Nodes for a join. Spark's own guess would take edges, which it can't size, for the small side."""
    return nodes.select("node").hint("broadcast" if count <= BROADCAST else "merge")


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Nodes that seeds (column node) reach over edges (src, dst), themselves included, with the round that found them.

    Cycles and self-references end because a node is visited once. Rounds are joins; how many new nodes there are
    reaches the driver, and the nodes themselves while they are few. Edges never do.
    """
    frontier = checkpointed(seeds.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    visited, depth, new = frontier, 0, frontier.count()
    seen = new
    while new and (max_rounds is None or depth < max_rounds):
        depth += 1
        found = edges.join(_sized(frontier, new), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).filter("node is not null")
        frontier = checkpointed(found.distinct().join(_sized(visited, seen), "node", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        visited, seen = visited.unionAll(frontier), seen + new
        if depth % FOLD == 0:
            visited = checkpointed(visited)
    return visited


def seed_labels(outputs: DataFrame) -> DataFrame:
    """hash and label of store outputs; of several for a hash, the first enumerated one's."""
    label = attr_label(F.col("attr"), F.col("output"))
    return outputs.groupBy("hash").agg(F.min_by(label, F.struct("run", "ordinal")).alias("label"))


def labelled_entries(outputs: DataFrame, infos: DataFrame, listings: DataFrame, follow_refs: bool = False) -> DataFrame:
    """File records of all hashes, each owned by its hash's label: a seed's, else the store path's name, else the hash.

    Directories go. Without ``follow_refs`` the seeds alone are listed.
    """
    labels = seed_labels(outputs)
    if follow_refs:
        infos = checkpointed(infos.select("hash", "store_path", "references"))  # parsed once, not in every round
        edges = infos.select(F.col("hash").alias("src"), F.explode("references").alias("dst"))
        nodes = closure(labels.select(F.col("hash").alias("node")), edges).select(F.col("node").alias("hash"))
        paths = infos.groupBy("hash").agg(F.max("store_path").alias("store_path"))
        named = nodes.join(labels.hint("merge"), "hash", "left").join(paths.hint("merge"), "hash", "left")
        labels = named.select("hash", F.coalesce("label", transitive_label(F.col("store_path"), F.col("hash"))).alias("label"))
    files = listings.filter("kind <> 'd'").join(labels.hint("merge"), "hash")  # labels grow with the catalog: they don't go through the driver
    return files.select("path", "kind", "size", "executable", "target", F.array("label").alias("packages"))
