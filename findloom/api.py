"""The library's front: open, search, build and crawl."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.errors import EngineIOError, InvalidDatabaseError, ManifestError, UsageError
from findloom.operators.closure import labelled_entries
from findloom.operators.index import ORDER, search_index
from findloom.operators.merge import merge_owners, merge_records
from findloom.operators.output import render
from findloom.schemas import FILE_KEY, INDEX, OPTIONS, PACKAGES, SIZE
from findloom.sources import crawl as saved
from findloom.sources import legacy, manifests, tables, walk


@dataclass
class CrawlOptions:
    """A crawl over saved files.

    ``enumerations``: pairs (attr, XML file), in order; ``cache_dir``: the folder of metadata and listings.
    """

    enumerations: list[tuple[str, str]]
    cache_dir: str
    scope: str = ""
    attrs: list[str] = field(default_factory=list)
    system: str = ""
    follow_refs: bool = False

    def __post_init__(self) -> None:
        if self.scope and self.attrs:
            raise UsageError("scope and attrs exclude each other")


class Database:
    """An open database: ``kind``, ``records`` and ``search``."""

    def __init__(self, kind: str, records: DataFrame, parts: tuple[DataFrame, DataFrame] | None = None) -> None:
        self.kind, self.records, self._parts = kind, records, parts

    def search(self, query: str, form: str = "rows", empty: str = "reject") -> DataFrame:
        """Records whose name or path holds the query, literally and by case, in order.

        The empty query raises UsageError, or with ``empty="legacy"`` finds nothing in options and packages and
        everything in an index.
        """
        if query == "" and empty == "reject":
            raise UsageError("the query must not be empty")
        key = "name" if self.kind == OPTIONS else "path"
        if query == "" and self.kind != INDEX:
            found = self.records.filter(F.lit(False))
        elif self._parts is not None:
            found = search_index(self.records, *self._parts, query).drop("block_id")
        else:
            found = self.records.filter(F.contains(key, F.lit(query)))
        return render(found.orderBy(*(["name"] if key == "name" else [c for c in ORDER if c in found.columns])), form)


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def options_from_json(self, path: str) -> Database:
        """Options of a JSON file; entries that aren't options are passed over."""
        nodes = manifests.entries(manifests.read_json(self.spark, path)).filter("key is not null")
        return Database(OPTIONS, manifests.option_records(nodes.select("key", "node")))

    def open(self, path: str, kind: str | None = None) -> Database:
        """A native folder or an older file. ``kind`` names what is expected: ``options``, or ``packages`` for any that lists files."""
        native = tables.native_kind(self.spark, path)
        found = native or legacy.kind_of(self.spark, path)
        if kind == OPTIONS and found != OPTIONS:
            raise InvalidDatabaseError("expected an options database (kind = options)")
        if kind == PACKAGES and found == OPTIONS:
            raise InvalidDatabaseError("expected a packages or index database")
        if native is None:
            return Database(*legacy.read(self.spark, path))
        parts = tables.read_index_parts(self.spark, path) if native == INDEX else None
        return Database(native, tables.read_native(self.spark, path, native), parts)

    def build(self, manifest: str, output: str, shape: str = "strict") -> dict[str, object]:
        """A database from a manifest, of options if it holds options, else of the files below its outputs."""
        root = manifests.read_json(self.spark, manifest)
        nodes = manifests.entries(root).filter("key is not null").select("key", "node")
        shapes = manifests.option_shapes(nodes).head()
        if shapes["options"]:
            if shapes["other"]:
                raise ManifestError("the manifest holds both options and other entries")
            tables.write_options(manifests.option_records(nodes), output)
            return {"kind": OPTIONS, "options": shapes["options"], "output": output}
        outputs = walk.existing(manifests.manifest_outputs(self.spark, manifest, shape))
        n = tables.count(outputs)
        if not n:
            raise ManifestError("the manifest holds no option and no output folder that exists")
        merged = merge_owners(walk.package_files(outputs), ["path"], "package")
        plain = merged.select(
            "path", F.lit("r").alias("kind"), F.lit(0).cast(SIZE).alias("size"), F.lit(False).alias("executable"), F.lit("").alias("target"), "packages"
        )
        tables.write_packages(plain, output)
        paths = tables.count(tables.read_native(self.spark, output, PACKAGES))
        return {"kind": PACKAGES, "paths": paths, "outputs": n, "output": output}

    def crawl(self, options: CrawlOptions, output: str) -> dict[str, object]:
        """An index from saved enumerations, metadata and listings."""
        runs = options.enumerations
        if options.attrs:
            runs = [r for a in options.attrs for r in runs if r[0] == a]
        elif options.scope:
            runs = [r for r in runs if r[0] == options.scope]
        if not runs:
            raise EngineIOError("no enumeration to read")
        outputs = saved.read_enumerations(self.spark, runs)
        if options.system:
            outputs = outputs.filter(F.col("system").isin("", options.system))
        infos, listings = saved.read_infos(self.spark, options.cache_dir), saved.read_listings(self.spark, options.cache_dir)
        entries = labelled_entries(outputs, infos, listings, options.follow_refs)
        raw = tables.count(entries)
        tables.write_index(merge_records(entries, FILE_KEY), output)
        files = tables.count(tables.read_native(self.spark, output, INDEX))
        return {"kind": INDEX, "format": "parquet", "files": files, "entries": raw, "output": output}


def open_db(spark: SparkSession, path: str, kind: str | None = None) -> Database:
    return Engine(spark).open(path, kind)
