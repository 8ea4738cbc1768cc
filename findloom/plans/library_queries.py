"""Queries that go through the library's own readers, writers and engine, over inputs made of the driver tables.

Manifests, enumerations, folders and databases are written to the shared folder and read back as a user's would be.
"""

from __future__ import annotations

import os
import struct

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.api import CrawlOptions, Engine
from findloom.operators.closure import labelled_entries
from findloom.operators.index import assign_blocks
from findloom.operators.merge import merge_owners as merged
from findloom.operators.merge import merge_records
from findloom.plans.catalog_queries import _FILES_SQL, _files, query, table
from findloom.schemas import FILE_KEY, SIZE
from findloom.sources import crawl, legacy, manifests, tables, walk
from findloom.sources.shared import scratch

_MOD = "s_suppkey % 6"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _manifests(spark: SparkSession, sf_dir: str, node: Column, keep: str = "true") -> str:
    """A folder of JSON manifests, one for each nation: its suppliers by name, each with a node."""
    rows = table(spark, sf_dir, "supplier").filter(keep)
    entry = F.concat(F.lit('"'), "s_name", F.lit('": '), node)
    texts = rows.groupBy("s_nationkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ",\n"), F.lit("}")).alias("value"))
    path = scratch(spark, "manifests")
    texts.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return path


def _option_node() -> Column:
    name = F.col("s_name")
    return (
        F.when(F.expr(f"{_MOD} = 0"), F.concat(F.lit('{"loc": ["a"], "type": "t", "description": "  two   words '), name, F.lit('"}')))
        .when(F.expr(f"{_MOD} = 1"), F.lit('{"loc": [], "type": "string", "description": ""}'))
        .when(F.expr(f"{_MOD} = 2"), F.concat(F.lit('{"loc": null, "type": null, "description": {"text": " x '), name, F.lit('  "}}')))
        .when(F.expr(f"{_MOD} = 3"), F.lit('{"type": "string"}'))
        .when(F.expr(f"{_MOD} = 4"), F.lit('{"loc": ["a"], "type": "int", "description": {"text": ""}}'))
        .otherwise(F.lit('{"loc": 1, "type": 2, "description": 3, "defaultText": {"text": "z"}}'))
    )


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return manifests.entries(manifests.read_json(spark, path)).filter("key is not null").select("key", "node")


_OPTIONS_SQL = f"""SELECT s_name AS name, CASE {_MOD} WHEN 0 THEN 'two words ' || s_name WHEN 2 THEN 'x ' || s_name WHEN 4 THEN 'int' WHEN 5 THEN 'z' END AS summary
    FROM supplier WHERE {_MOD} <> 3"""


@query(_OPTIONS_SQL)
def option_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01, O-42, O-81, O-82: options of JSON manifests."""
    return manifests.option_records(_nodes(spark, _manifests(spark, sf_dir, _option_node())))


@query(f"SELECT count(*) FILTER ({_MOD} <> 3) AS options, count(*) FILTER ({_MOD} = 3) AS other FROM supplier")
def option_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42, O-62: nodes that are options and others, in one pass."""
    return manifests.option_shapes(_nodes(spark, _manifests(spark, sf_dir, _option_node())))


@query("SELECT name, summary, (SELECT count(*) FROM supplier WHERE s_suppkey % 6 <> 3) AS options FROM (" + _OPTIONS_SQL + ") WHERE contains(name, '7')")
def build_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-18 to O-20, O-27, O-40, O-67, O-71: a database of options, built, opened, searched, and what the build says."""
    engine, path = Engine(spark), scratch(spark, "options")
    said = engine.build(_manifests(spark, sf_dir, _option_node(), f"{_MOD} <> 3"), path)
    return engine.open(path, "options").search("7").withColumn("options", F.lit(said["options"]).cast("bigint"))


@query(f"""
    WITH s AS (SELECT s_name AS k, '/p/' || s_suppkey AS p, '/q/' || s_suppkey AS q, {_MOD} AS m FROM supplier)
    SELECT k AS name, p AS path FROM s WHERE m IN (0, 2, 3) UNION ALL SELECT 'other-1.5', p FROM s WHERE m = 1
    UNION ALL SELECT k || '.man', q FROM s WHERE m = 2 UNION ALL SELECT k, q FROM s WHERE m IN (3, 4) UNION ALL SELECT k, p FROM s WHERE m = 4""")
def manifest_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-02, O-03, O-83: outputs of package manifests, of each form that an entry can have."""
    key = F.col("s_suppkey").cast("string")
    form = lambda text: F.replace(F.replace(F.lit(text), F.lit("P"), F.concat(F.lit("/p/"), key)), F.lit("Q"), F.concat(F.lit("/q/"), key))
    node = (
        F.when(F.expr(f"{_MOD} = 0"), form('"P"'))
        .when(F.expr(f"{_MOD} = 1"), form('{"path": "P", "pname": "x", "attr": "other", "version": "1.5"}'))
        .when(F.expr(f"{_MOD} = 2"), form('{"outputs": {"out": "P", "man": "Q", "bad": 1}}'))
        .when(F.expr(f"{_MOD} = 3"), form('{"outputs": ["P", "Q", null]}'))
        .when(F.expr(f"{_MOD} = 4"), form('{"path": "P", "outputs": "Q"}'))
        .otherwise(F.lit("5"))
    )
    return manifests.manifest_outputs(spark, _manifests(spark, sf_dir, node))


@query("""
    WITH files AS (SELECT n_name AS owner, '/bin/tool' AS path FROM nation UNION ALL SELECT n_name, '/share/' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_name, '/bin/link' FROM nation WHERE n_nationkey % 2 = 1)
    SELECT path, string_agg(owner, ',' ORDER BY owner) AS owners FROM files GROUP BY path""")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-04 to O-06, O-45, O-61: files below a folder for each nation (a table of fixed size); one more folder isn't there."""
    base = _local(scratch(spark, "tree"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for row in nations.select("n_nationkey", "n_name", "r_name").collect():
        for file in ("bin/tool", f"share/{row['r_name']}"):
            path = f"{base}/{row['n_name']}/{file}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w"):
                pass
        if row["n_nationkey"] % 2:
            os.symlink("tool", f"{base}/{row['n_name']}/bin/link")
            os.symlink("bin", f"{base}/{row['n_name']}/folder")
    outputs = nations.select(F.col("n_name").alias("name"), F.concat(F.lit(f"{base}/"), "n_name", F.lit("/")).alias("path"))
    outputs = outputs.unionByName(nations.select(F.lit("gone").alias("name"), F.lit(f"{base}/none").alias("path")).distinct())
    return merged(walk.package_files(outputs), ["path"], "package", "owners").withColumn("owners", F.array_join("owners", ","))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt out to tasks, as one task may read the whole file."""
    return table(spark, sf_dir, "part").repartition("p_partkey")


@query(r"""
    WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS name, p_size AS v FROM part)
    SELECT CASE WHEN k % 5 = 0 THEN 'top' ELSE name END AS attr, name AS pname, v::VARCHAR AS version, 'out' AS output, '/store/h' || k || '-' || name || '-' || v AS store_path, 'h' || k AS hash FROM p
    UNION ALL SELECT CASE WHEN k % 5 = 0 THEN 'top' ELSE name END, name, v || '-man', 'man', '/store/m' || k || '-' || name || '-' || v || '-man', 'm' || k FROM p WHERE k % 2 = 0""")
def enumeration_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07, O-08, O-84, O-85: outputs that enumeration files list."""
    name, key, size = F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    output = lambda out, letter, end: F.struct(F.lit(out).alias("_name"), F.concat(F.lit(f"/store/{letter}"), key, F.lit("-"), name, F.lit("-"), size, F.lit(end)).alias("_path"))
    man = F.when(F.col("p_partkey") % 2 == 0, F.array(output("man", "m", "-man"))).otherwise(F.array())
    outputs = F.concat(F.array(output("out", "h", ""), output("", "n", "")), man)
    items = _dealt(spark, sf_dir).select(F.when(F.col("p_partkey") % 5 != 0, name).alias("_attrPath"), F.lit("x").alias("_system"), outputs.alias("output"))
    path = scratch(spark, "enumeration")
    items.write.format("xml").option("rootTag", "items").option("rowTag", "item").save(path)
    return crawl.read_enumerations(spark, [("top", path)]).select("attr", "pname", "version", "output", "store_path", "hash")


@query(r"""SELECT 'k' || p_partkey AS hash, '/store/k' || p_partkey || '-' || p_type AS store_path, 'nar/' || p_brand AS nar_url,
    'a' || p_size || ',' || p_type || ',self' AS refs FROM part""")
def reference_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-09, O-88: metadata texts; the last of repeated keys counts."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    value = F.concat(
        F.lit("URL: old\r\nStorePath: /store/k"), key, F.lit("-"), "p_type", F.lit("\r\n no key \nURL:  nar/"), "p_brand",
        F.lit(" \nReferences: a"), size, F.lit("-x-1  /store/"), "p_type", F.lit("-y self\n"),
    )
    found = crawl.parse_infos(table(spark, sf_dir, "part").select(F.concat(F.lit("k"), key).alias("hash"), value.alias("value")))
    return found.select("hash", "store_path", "nar_url", F.array_join("references", ",").alias("refs"))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of each part: hash and value."""
    value = F.concat(
        F.lit('{"root": {"type": "directory", "entries": {"bin": {"type": "directory", "entries": {"'), "p_name",
        F.lit('": {"type": "regular", "size": '), F.col("p_size").cast("string"), F.lit(', "executable": '), (F.col("p_size") % 2 == 1).cast("string"),
        F.lit('}, "odd": {"type": "socket"}}}, "doc": {"type": "symlink", "target": "'), "p_brand", F.lit('"}}}}'),
    )
    value = F.when(F.col("p_partkey") % 11 == 0, "no JSON").otherwise(value)
    return _dealt(spark, sf_dir).select(F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("hash"), value.alias("value"))


_LISTED_SQL = """
    listed AS (SELECT * FROM part WHERE p_partkey % 11 <> 0),
    rows AS (SELECT p_partkey AS k, '/' AS path, 'd' AS kind, 0 AS size, false AS executable, '' AS target FROM listed
        UNION ALL SELECT p_partkey, '/bin', 'd', 0, false, '' FROM listed UNION ALL SELECT p_partkey, '/doc', 's', 0, false, p_brand FROM listed
        UNION ALL SELECT p_partkey, '/bin/' || p_name, 'r', p_size, p_size % 2 = 1, '' FROM listed)"""


@query(f"WITH {_LISTED_SQL} SELECT 'h' || k AS hash, path, kind, size::BIGINT AS size, executable, target FROM rows")
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10, O-11, O-89: recursive listings as rows."""
    return crawl.parse_listings(_listings(spark, sf_dir)).withColumn("size", F.col("size").cast("bigint"))


def _entries(spark: SparkSession, sf_dir: str, follow: bool) -> DataFrame:
    """File records of parts with key 1 of each ten, which refer to 2, 2 to 3, 3 to 4, and 4 to 1 and itself."""
    parts = table(spark, sf_dir, "part")
    last, key = F.col("p_partkey") % 10, F.col("p_partkey").cast("string")
    ident = F.concat(F.lit("h"), key)
    spot = F.struct(F.col("p_partkey").alias("item"), F.lit(0).alias("position"))
    seeds = parts.filter(last == 1).select(F.col("p_name").alias("attr"), F.when(F.col("p_size") % 2 == 0, "man").otherwise("out").alias("output"), ident.alias("hash"), F.lit(1).alias("run"), spot.alias("ordinal"))
    later = seeds.withColumns({"attr": F.lit("late"), "run": F.lit(2)})
    goal = F.concat(F.lit("/store/h"), (F.col("p_partkey") - last + last % 4 + 1).cast("string"), F.lit("-next"))
    refs = F.when(last.between(1, 4), F.concat(goal, F.lit(" "), ident)).otherwise("")
    store = F.when(last == 3, "").otherwise(F.concat(F.lit("/store/"), ident, F.lit("-"), "p_brand"))
    infos = crawl.parse_infos(_dealt(spark, sf_dir).select(ident.alias("hash"), F.concat(F.lit("StorePath: "), store, F.lit("\nReferences: "), refs, F.lit("\n")).alias("value")))
    found = labelled_entries(later.unionByName(seeds), infos, crawl.parse_listings(_listings(spark, sf_dir)), follow)
    return found.withColumns({"size": F.col("size").cast("bigint"), "packages": F.array_join("packages", ",")})


_LABELLED_SQL = f"""WITH {_LISTED_SQL}
    SELECT path, kind, size::BIGINT AS size, executable, target, CASE k % 10 WHEN 1 THEN p_name || CASE WHEN p_size % 2 = 0 THEN '.man' ELSE '' END WHEN 3 THEN 'h' || k ELSE p_brand END AS packages
    FROM rows JOIN part ON p_partkey = k WHERE kind <> 'd' AND k % 10 BETWEEN 1 AND """


@query(_LABELLED_SQL + "1")
def seed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43, O-86, O-101 to O-103: files of the seeds alone, by the label of the run that came first."""
    return _entries(spark, sf_dir, False)


@query(_LABELLED_SQL + "4")
def closure_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43, O-50, O-51, O-87, O-88, O-100 to O-102: files of all that seeds reach, labelled."""
    return _entries(spark, sf_dir, True)


@query("""SELECT '/' || p_type AS path, 'r' AS kind, (p_size % 3)::BIGINT AS size, p_size % 2 = 1 AS executable, '' AS target,
    coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FILTER (p_size % 4 <> 0), '') AS packages FROM part WHERE p_size % 5 <> 0 GROUP BY ALL""")
def merge_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44, O-45, O-60: records by all their fields; root paths, empty paths and empty owners go."""
    path = F.when(F.col("p_size") % 10 == 0, "/").when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("/"), "p_type"))
    owner = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    records = table(spark, sf_dir, "part").select(
        path.alias("path"), F.lit("r").alias("kind"), (F.col("p_size") % 3).cast(SIZE).alias("size"), (F.col("p_size") % 2 == 1).alias("executable"),
        F.lit("").alias("target"), F.array(owner, F.lit("")).alias("packages"),
    )
    found = merge_records(records, FILE_KEY)
    return found.withColumns({"size": F.col("size").cast("bigint"), "packages": F.array_join("packages", ",")})


@query(_FILES_SQL + """, sized AS (SELECT *, strlen(path || chr(9) || kind || chr(9) || size || chr(9) || CASE WHEN executable THEN '1' ELSE '0' END || chr(9) || target || chr(9) || packages) + 1 AS n FROM files)
    SELECT path, coalesce(sum(n) OVER (ORDER BY path, kind, target, size, executable ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4096 AS block_id FROM sized""")
def block_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-36, O-72: blocks by the bytes of ordered records."""
    return assign_blocks(_files(spark, sf_dir), 4096).select("path", "block_id")


_FOUND_SQL = _FILES_SQL + " SELECT path, kind, size::BIGINT AS size, executable, target, packages FROM files WHERE contains(path, '"


def _plain(found: DataFrame) -> DataFrame:
    return found.withColumns({"size": F.col("size").cast("bigint"), "packages": F.array_join("packages", ",")})


@query(_FOUND_SQL + "/red bolt/')")
def written_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-18, O-19, O-21, O-41, O-73: a database of files, written, opened and searched by scan."""
    path = scratch(spark, "packages")
    tables.write_packages(_files(spark, sf_dir), path)
    return _plain(Engine(spark).open(path, "packages").search("/red bolt/"))


@query(_FOUND_SQL + "bolt/12')")
def written_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-18, O-23, O-37, O-39, O-53, O-54, O-72, O-74, O-76: an index, written, opened and searched by its trigrams."""
    path = scratch(spark, "index")
    tables.write_index(_files(spark, sf_dir), path)
    return _plain(Engine(spark).open(path).search("bolt/12"))


@query("""SELECT '/bin/' || n_name AS path, 'r' AS kind, n_nationkey::BIGINT AS size, true AS executable, '' AS target, n_name AS packages FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT '/bin/' || n_name, 'r', n_nationkey, true, '', r_name || '-1' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1""")
def crawl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07 to O-11, O-18, O-23, O-27, O-60, O-100 to O-102: a crawl of saved files, one item for each second nation, which refers to the next one."""
    base = _local(scratch(spark, "crawl"))
    os.makedirs(f"{base}/cache")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = []
    for row in nations.select("n_nationkey", "n_name", "r_name").collect():  # 25 rows at every size
        n, name = row["n_nationkey"], row["n_name"]
        with open(f"{base}/cache/h{n}.ls", "w") as file:
            file.write(f'{{"root": {{"type": "directory", "entries": {{"bin": {{"type": "directory", "entries": {{"{name}": {{"type": "regular", "size": {n}, "executable": true}}}}}}}}}}}}')
        with open(f"{base}/cache/h{n}.narinfo", "w") as file:
            file.write(f"StorePath: /store/h{n}-{row['r_name']}-1\nReferences: h{n + 1}-x h{n}-y\n")
        if n % 2 == 0:
            items.append(f'<item attrPath="{name}" system="x"><output name="out" path="/store/h{n}-{name}-1"/></item>')
    with open(f"{base}/items.xml", "w") as file:
        file.write("<items>" + "\n".join(items) + "</items>")
    engine = Engine(spark)
    engine.crawl(CrawlOptions([("", f"{base}/items.xml")], f"{base}/cache", follow_refs=True), f"{base}/index")
    return _plain(engine.open(f"{base}/index").search("/bin/"))


def _packed(text: str) -> bytes:
    return zstandard.ZstdCompressor().compress(text.encode())


def _bucketed(kind: str, lines: list[str]) -> bytes:
    """An older file of 256 buckets, by the bytes of a line's key."""
    blobs = [[x for x in lines if bucket in x.split("\t")[0].encode()] for bucket in range(legacy.BUCKETS)]
    blobs = [_packed("\n".join(own)) if own else b"" for own in blobs]
    spots = b"".join(struct.pack("<QQ", sum(map(len, blobs[:i])), len(blob)) for i, blob in enumerate(blobs))
    return legacy.MAGICS[1] + f"\t{kind}\n".encode() + spots + b"".join(blobs)


def _older(spark: SparkSession, data: bytes) -> str:
    path = f"{_local(scratch(spark, 'older'))}/file.db"
    os.makedirs(os.path.dirname(path))
    with open(path, "wb") as file:
        file.write(data)
    return path


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE r_name || chr(9) || n_nationkey || chr(8232) || 'x' END AS summary FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, '_1')")
def older_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-14, O-18, O-32, O-40, O-46: an older file of options, one for each nation (25 rows at every size), opened and searched."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = [f"{r['n_name']}\t" + ("" if r["n_nationkey"] % 3 == 0 else f"{r['r_name']}\t{r['n_nationkey']} x") for r in nations.collect()]
    return Engine(spark).open(_older(spark, _bucketed("options", lines)), "options").search("_1")


_OLDER_SQL = """SELECT '/share/' || n_name AS path, CASE n_nationkey % 3 WHEN 0 THEN 's' ELSE 'r' END AS kind, n_nationkey::BIGINT AS size, n_nationkey % 2 = 1 AS executable,
    CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE '' END AS target, """


def _older_rows(spark: SparkSession, sf_dir: str) -> list[tuple]:
    found = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return [(f"/share/{r['n_name']}", "r" if r["n_nationkey"] % 3 else "s", r["n_nationkey"], r["n_nationkey"] % 2, "" if r["n_nationkey"] % 3 else r["n_name"]) for r in found]


@query(_OLDER_SQL + "'a,b' || n_regionkey AS packages FROM nation WHERE contains(n_name, 'N_2')")
def older_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-15, O-18, O-30, O-41, O-91, O-92: an older file of file lines, opened and searched."""
    regions = {r["n_nationkey"]: r["n_regionkey"] for r in table(spark, sf_dir, "nation").collect()}
    lines = [f"{path}\t{kind}\t{n}\t{run}\t{target}\ta,b{regions[n]}" for path, kind, n, run, target in _older_rows(spark, sf_dir)]
    return _plain(Engine(spark).open(_older(spark, _bucketed("packages", lines)), "packages").search("N_2"))


@query(_OLDER_SQL + "'owner' AS packages FROM nation WHERE contains(n_name, 'N_2')")
def older_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-17, O-18, O-33, O-35, O-93: an older stream of records whose paths leave out what they share with the one before."""
    lines, before = ["P\towner"], ""
    for path, kind, n, run, target in _older_rows(spark, sf_dir):
        shared = len(os.path.commonprefix([before, path]))
        lines.append(f"F\t{kind}\t{n}\t{run}\t{target}\t{shared}\t{path[shared:]}")
        before = path
    data = legacy.MAGICS[1] + b"\tindex\n" + _packed("\n".join([*lines, "odd line", "F\tr\tx"]))
    return _plain(Engine(spark).open(_older(spark, data)).search("N_2"))
