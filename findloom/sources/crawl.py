"""Saved crawl inputs: package enumerations (XML), reference metadata and file listings."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.errors import EngineIOError
from findloom.functions.text import BLANK, basename, hash_from_path, reference_hashes, split_name_version
from findloom.schemas import LISTING, MAX_SIZE

#: Entries of listings that leave Python at once.
ROWS = 10_000
_ITEM = "_attrPath string, _system string, output array<struct<_name string, _path string>>"
#: A start tag's attributes. Comments, CDATA, declarations and instructions, but for the first line's, can hold what looks like tags.
_ATTRIBUTES = r"""(?:\s++[^\s=<>"'/]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+\s*+"""
_HIDING = r"<!|<\?(?!xml\s)"


def _items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an enumeration file in its order: _attrPath, _system and output.

    The XML reader gives a file to one task whole, so the text is cut where items begin and each piece is parsed.
    Files with markup that could hide where an item begins or ends go to the XML reader. Of an item that isn't
    well-formed nothing is read.
    """
    pieces = spark.read.schema("value string").text(path, lineSep="<item")
    closed = F.regexp_count("value", F.lit(r"</item[\s>]"))
    plain = F.rlike("value", F.lit(f"^{_ATTRIBUTES}>")) & (closed == 1) & F.contains("value", F.lit("</item>"))
    empty = F.rlike("value", F.lit(f"^{_ATTRIBUTES}/>")) & (closed == 0)
    odd = F.rlike("value", F.lit(_HIDING)) | (F.rlike("value", F.lit(r"^[\s/>]")) & ~plain & ~empty)
    if pieces.agg(F.bool_or(odd)).first()[0]:
        return spark.read.format("xml").schema(_ITEM).option("rowTag", "item").load(path)
    text = F.concat(F.lit("<item"), F.substring_index("value", "</item>", 1), F.lit("</item>"))
    return pieces.filter(plain).select(F.from_xml(text, _ITEM).alias("item")).select("item.*")


def read_enumeration(spark: SparkSession, path: str, attr: str = "", run: int = 0) -> DataFrame:
    """Store outputs of an enumeration file: attr, system, pname, version, output, store_path, hash, run and ordinal.

    ``attr`` stands in for items without an attribute path. ordinal rises in file order.
    """
    rows = _items(spark, path).select(
        F.when(F.coalesce("_attrPath", F.lit("")) != "", F.col("_attrPath")).otherwise(F.lit(attr)).alias("attr"),
        F.coalesce("_system", F.lit("")).alias("system"),
        F.monotonically_increasing_id().alias("item"),
        F.posexplode_outer("output").alias("position", "out"),  # a plain one has each item parsed again, for a filter on the array's size
    ).select("attr", "system", F.struct("item", "position").alias("ordinal"), F.col("out._name").alias("output"), F.col("out._path").alias("store_path"))
    rows = rows.filter("output <> '' and store_path <> ''")
    name = basename(F.col("store_path"))
    full = F.when(F.instr(name, "-") > 1, F.substr(name, F.instr(name, "-") + 1)).otherwise(F.col("attr"))
    pname, version = split_name_version(F.col("full"))
    rows = rows.withColumn("full", full)
    return rows.select("attr", "system", pname.alias("pname"), version.alias("version"), "output", "store_path", hash_from_path(F.col("store_path")).alias("hash"), F.lit(run).alias("run"), "ordinal")


def read_enumerations(spark: SparkSession, runs: Sequence[tuple[str, str]]) -> DataFrame:
    """Several runs (attr, path), one after the other."""
    return reduce(DataFrame.unionByName, [read_enumeration(spark, path, attr, i) for i, (attr, path) in enumerate(runs)])


def _texts(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    texts = spark.read.schema("value string").text(folder, wholetext=True, pathGlobFilter=f"*{suffix}")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)" + suffix.replace(".", r"\.") + "$", 1)
    return texts.select(name.alias("hash"), "value")


def parse_infos(texts: DataFrame) -> DataFrame:
    """hash, store_path, nar_url and references of metadata texts (hash, value); of a repeated key the last value wins."""
    lines = texts.select("hash", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", f"^{BLANK}|{BLANK}$", "")))
    at = F.instr("line", ": ")
    pairs = lines.filter(at > 0).select("hash", "at", F.substr("line", F.lit(1), at - 1).alias("key"), F.trim(F.substr("line", at + 2)).alias("val"))
    last = lambda key: F.coalesce(F.max_by(F.when(F.col("key") == key, F.col("val")), F.when(F.col("key") == key, F.col("at"))), F.lit(""))
    found = pairs.groupBy("hash").agg(last("StorePath").alias("store_path"), last("URL").alias("nar_url"), last("References").alias("r"))
    return found.select("hash", "store_path", "nar_url", reference_hashes(F.col("r")).alias("references"))


def read_infos(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of a folder of ``<hash>.narinfo`` files; a hash without a file has no row."""
    return parse_infos(_texts(spark, folder, ".narinfo"))


def flatten(node: object) -> Iterator[tuple[str, str, int, bool, str]]:
    """path, kind, size, executable and target of a listing's root node and all below it, in the tree's order."""
    stack = [("/", node)]
    while stack:
        path, node = stack.pop()
        if not isinstance(node, dict):
            continue
        kind = node.get("type")
        if kind == "regular":
            size = node.get("size")
            size = size if isinstance(size, int) and not isinstance(size, bool) and 0 <= size <= MAX_SIZE else 0
            yield path, "r", size, node.get("executable") is True, ""
        elif kind == "symlink":
            target = node.get("target")
            yield path, "s", 0, False, target if isinstance(target, str) else ""
        elif kind == "directory":
            yield path, "d", 0, False, ""
            below = node.get("entries")
            if isinstance(below, dict):
                stack += [(("" if path == "/" else path) + "/" + name, x) for name, x in reversed(below.items())]


def listing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of batches of listing texts (hash, value), ``ROWS`` to a batch however long or short the listings are."""
    names, kinds = LISTING.names, [pa.string(), pa.string(), pa.string(), pa.decimal128(20, 0), pa.bool_(), pa.string()]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds, strict=True)], names=names)
    rows = []
    for batch in batches:
        for ident, text in zip(batch.column("hash").to_pylist(), batch.column("value").to_pylist(), strict=True):
            try:
                root = json.loads(text)
            except (ValueError, TypeError, RecursionError):
                continue
            for entry in flatten(root.get("root") if isinstance(root, dict) else None):
                rows.append((ident, *entry))
                if len(rows) == ROWS:
                    yield packed(rows)
                    rows = []
    if rows:
        yield packed(rows)


def parse_listings(texts: DataFrame) -> DataFrame:
    """hash, path, kind, size, executable and target of listing texts (hash, value).

    A text that isn't JSON, or has no root, lists nothing. One pass over each listing, however deep its tree.
    """
    return texts.select("hash", "value").mapInArrow(listing_batches, LISTING)


def read_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of a folder of ``<hash>.ls`` files; a hash without a file lists nothing.

    Raises EngineIOError where a hash has only the compressed form, which would leave the index incomplete.
    """
    packed = _texts(spark, folder, ".ls.xz").select("hash")
    plain = _texts(spark, folder, ".ls")
    alone = packed.join(plain.select("hash"), "hash", "left_anti").limit(1).collect()
    if alone:
        raise EngineIOError(f"only a compressed listing for {alone[0]['hash']}; the index would be incomplete")
    return parse_listings(plain)
