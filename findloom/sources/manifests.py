"""JSON manifests: options, and packages with their output paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.errors import EngineIOError, ManifestError
from findloom.functions.text import child, is_object, is_option, is_string, option_summary, package_name, string_field, string_value


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row with the whole file as variant ``v``. Of a key that's repeated the last value wins."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        texts = spark.read.text(path, wholetext=True)
    except Exception as error:  # a path that isn't there
        raise EngineIOError(str(error).splitlines()[0]) from error
    return texts.select(F.parse_json("value").alias("v"))


def entries(df: DataFrame, column: str = "v") -> DataFrame:
    """Add key and node for each entry of an object or array; scalars have none."""
    return df.sparkSession.sql(f"SELECT d.*, e.key, e.value AS node FROM {{d}} AS d, LATERAL variant_explode({column}) AS e", d=df)


def option_records(nodes: DataFrame) -> DataFrame:
    """name and summary of the option nodes among entries (key, node); empty summaries are NULL."""
    options = nodes.filter(is_option(F.col("node")))
    return options.select(F.col("key").alias("name"), F.nullif(option_summary(F.col("node")), F.lit("")).alias("summary"))


def option_shapes(nodes: DataFrame) -> DataFrame:
    """Counts of option and other nodes, as one row."""
    option = F.coalesce(is_option(F.col("node")), F.lit(False))
    return nodes.agg(F.count_if(option).alias("options"), F.count_if(~option).alias("other"))


def _outputs(nodes: DataFrame, shape: str) -> DataFrame:
    """attr, pname, version, output and path of each output that a manifest's entries (key, node) name."""
    node, key = F.col("node"), F.coalesce("key", F.lit(""))
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    attr = either(string_field(node, "attr"), key)
    known = nodes.select(
        "node", key.alias("k"), attr.alias("attr"), either(string_field(node, "pname"), attr).alias("pname"),
        string_field(node, "version").alias("version"), child(node, "outputs").alias("outputs"),
    )
    row = lambda df, output, path: df.select("attr", "pname", "version", output.alias("output"), path.alias("path"))
    out = F.lit("out")
    plain = known.filter(is_string(F.col("node"))).select(F.col("k").alias("attr"), F.col("k").alias("pname"), F.lit("").alias("version"), out.alias("output"), string_value(F.col("node")).alias("path"))
    objects = known.filter(is_object(F.col("node")))
    single = row(objects, out, string_field(F.col("node"), "path"))
    text = row(objects.filter(is_string(F.col("outputs"))), out, string_value(F.col("outputs")))
    listed = entries(objects.drop("node").filter(F.col("outputs").isNotNull()), "outputs")
    many = row(listed.filter(is_string(F.col("node"))), F.coalesce("key", out), string_value(F.col("node")))
    found = plain.unionByName(single).unionByName(text).unionByName(many)
    if shape == "documented":
        bare = objects.filter("outputs is null").filter(child(F.col("node"), "path").isNull()).withColumnRenamed("node", "object")
        named = entries(bare, "object").filter(~F.col("key").isin("attr", "pname", "version") & is_string(F.col("node")))
        found = found.unionByName(row(named, F.col("key"), string_value(F.col("node"))))
    return found.filter("path <> ''")


def manifest_outputs(spark: SparkSession, path: str, shape: str = "strict") -> DataFrame:
    """name and path of each package output of a manifest; ``shape="documented"`` also takes bare maps of outputs.

    An array's items count if they are objects. Raises ManifestError where the root is neither array nor object.
    """
    if shape not in ("strict", "documented"):
        raise ValueError(f"unknown shape: {shape}")
    root = read_json(spark, path)
    form = root.select(F.schema_of_variant("v").alias("s")).head()["s"]
    if not form.startswith(("ARRAY", "OBJECT")):
        raise ManifestError("a manifest is a JSON list or object")
    nodes = entries(root)
    if form.startswith("ARRAY"):
        nodes = nodes.filter(is_object(F.col("node")))
    found = _outputs(nodes.select("key", "node"), shape)
    return found.select(package_name(F.col("attr"), F.col("pname"), F.col("version"), F.col("output")).alias("name"), "path")


