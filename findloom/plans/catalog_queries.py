"""Catalog queries over the driver tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findloom.functions import lines, text
from findloom.operators.closure import closure as reach
from findloom.operators.index import postings, search_index
from findloom.operators.merge import dictionary, first_wins
from findloom.operators.merge import merge_owners as merged
from findloom.operators.output import file_json, file_text, option_json
from findloom.operators.ranges import global_index
from findloom.schemas import SIZE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


@query("""
    SELECT p_name, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS owners
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE contains(p_name, 'bolt') GROUP BY p_name""")
def merge_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-61, O-41: parts and their sorted distinct suppliers, for part names that contain ``bolt``."""
    parts = table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit("bolt"))).select("p_partkey", "p_name")
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    pairs = sold.select("p_name", "l_suppkey").distinct()
    named = pairs.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return merged(named, ["p_name"], "s_name", "owners").withColumn("owners", F.array_join("owners", ","))


@query("""
    SELECT p_name, p_brand, p_type, p_size, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS owners
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def merge_owners_record_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-60: owners by a key of several columns."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    keys = ["p_name", "p_brand", "p_type", "p_size"]
    rows = pairs.join(table(spark, sf_dir, "part").select("p_partkey", *keys), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return merged(rows, keys, "s_name", "owners").withColumn("owners", F.array_join("owners", ","))


@query("SELECT page_id, url FROM pages WHERE contains(url, '/es/')")
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41: literal search in paths, pushed to the scan."""
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(F.contains("url", F.lit("/es/")))


@query("""
    SELECT q AS query, count(p_partkey) AS hits FROM (VALUES ('bolt'), ('Bolt'), ('b%t'), ('b.lt'), ('o')) AS t(q)
    LEFT JOIN part ON contains(p_name, q) GROUP BY q""")
def search_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40: matching is by case, and wildcards are plain characters."""
    wanted = ("bolt", "Bolt", "b%t", "b.lt", "o")
    counts = [F.count_if(F.contains("p_name", F.lit(q))).alias(f"q{i}") for i, q in enumerate(wanted)]
    pairs = F.array(*[F.struct(F.lit(q).alias("query"), F.col(f"q{i}").alias("hits")) for i, q in enumerate(wanted)])
    return table(spark, sf_dir, "part").agg(*counts).select(F.explode(pairs).alias("x")).select("x.query", "x.hits")


def _url_blocks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").filter("url is not null")
    return global_index(pages, ["url", "page_id"], "n").select("page_id", "url", F.expr(f"n div {size}").alias("block_id"))


_BLOCKS_SQL = "SELECT page_id, url, (row_number() OVER (ORDER BY url, page_id) - 1) // 16 AS block_id FROM pages WHERE url IS NOT NULL"
_TRIGRAMS_SQL = f"""
    blocks AS ({_BLOCKS_SQL}),
    raw AS (SELECT block_id, hex(encode(url)) AS h FROM blocks),
    grams AS (SELECT DISTINCT block_id, substr(h, 2 * i - 1, 6) AS trigram FROM raw, unnest(range(1, length(h) // 2 - 1)) AS u(i)),
    most AS (SELECT greatest(1, count(DISTINCT block_id) // 8) AS m FROM blocks)"""


@query("SELECT page_id, url FROM pages WHERE contains(url, 'fr')")
def search_short_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41, O-90: a query without trigrams reads all blocks."""
    blocks = _url_blocks(spark, sf_dir)
    return search_index(blocks, *postings(blocks, "url"), "fr", "url").select("page_id", "url")


@query("SELECT '/45' AS query, page_id, url FROM pages WHERE contains(url, '/45') UNION ALL SELECT 'zzqq', page_id, url FROM pages WHERE contains(url, 'zzqq') UNION ALL SELECT 'example.net/fr/2', page_id, url FROM pages WHERE contains(url, 'example.net/fr/2')")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53, O-54, O-76: search through the index gives what a full scan gives."""
    blocks = _url_blocks(spark, sf_dir, 4).cache()  # three searches read the index
    trigrams, posted = (part.cache() for part in postings(blocks, "url"))
    found = [search_index(blocks, trigrams, posted, q, "url").select(F.lit(q).alias("query"), "page_id", "url") for q in ("/45", "zzqq", "example.net/fr/2")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(_BLOCKS_SQL)
def block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-36: blocks of a fixed number of ordered records, numbered without a single task."""
    return _url_blocks(spark, sf_dir)


@query(f"WITH {_TRIGRAMS_SQL} SELECT trigram, count(*) AS doc_freq, count(*) > any_value(m) AS skipped FROM grams, most GROUP BY trigram")
def trigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-64, O-65: blocks that have a byte trigram, and whether that's too many."""
    return postings(_url_blocks(spark, sf_dir), "url")[0]


@query(f"""WITH {_TRIGRAMS_SQL} SELECT trigram, array_to_string(list_sort(list(block_id)), ',') AS blocks
    FROM grams, most GROUP BY trigram HAVING count(*) <= any_value(m)""")
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-66: the blocks of each trigram that isn't skipped."""
    posted = postings(_url_blocks(spark, sf_dir), "url")[1]
    blocks = F.transform(F.sort_array(F.collect_set("block_id")), lambda b: b.cast("string"))
    return posted.groupBy("trigram").agg(F.array_join(blocks, ",").alias("blocks"))


@query(f"""WITH {_TRIGRAMS_SQL} SELECT block_id FROM grams WHERE trigram = hex(encode('/es')) INTERSECT SELECT block_id FROM grams WHERE trigram = hex(encode('htt'))""")
def intersect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-76: blocks that two lists share."""
    pairs = _url_blocks(spark, sf_dir).select("block_id", F.explode(text.byte_trigrams(F.col("url"))).alias("trigram")).distinct()
    lists = pairs.filter(F.col("trigram").isin(text.query_trigrams("/es") + text.query_trigrams("htt")))
    return lists.groupBy("block_id").agg(F.count("*").alias("n")).filter("n = 2").select("block_id")


@query("SELECT s_name AS name, row_number() OVER (ORDER BY s_name) - 1 AS id FROM (SELECT DISTINCT s_name FROM supplier)")
def owner_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-68: distinct names with dense ids."""
    return dictionary(table(spark, sf_dir, "supplier"), "s_name")


@query("""SELECT count(*) FILTER (json_extract(props, '$.k') IS NOT NULL) AS options,
    count(*) FILTER (json_extract(props, '$.k') IS NULL) AS other FROM events""")
def option_shape_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-62: nodes with and without a key, in one pass."""
    has = text.child(F.try_parse_json("props"), "k").isNotNull()
    return table(spark, sf_dir, "events").select("props").agg(F.count_if(has).alias("options"), F.count_if(~has).alias("other"))


@query("SELECT coalesce(sum(try_cast(json_extract(props, '$.k') AS BIGINT)), 0)::BIGINT AS total FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-82: a typed field of JSON texts."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").agg(F.coalesce(F.sum(F.coalesce(value, F.lit(0))), F.lit(0)).alias("total"))


@query(r"""SELECT doc_id, coalesce(trim(regexp_replace(text, '[ \t\x0B\r\n\f]+', ' ', 'g'), ' '), '') AS summary FROM documents""")
def summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-81: an option's summary, from nodes made of each whole document."""
    node = F.parse_json(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("description"), F.col("lang").alias("type"))))
    return table(spark, sf_dir, "documents").select("doc_id", text.option_summary(node).alias("summary"))


_SUMMARIES = [
    ("a", '{"description": "  two  words\\n", "type": "t"}', "two words"),
    ("b", '{"description": "", "type": "t"}', ""),
    ("c", '{"description": {"text": ""}, "type": "string"}', "string"),
    ("d", '{"description": {"text": " x  y "}}', "x y"),
    ("e", '{"description": 5, "defaultText": {"text": "z"}}', "z"),
    ("f", '{"type": null}', ""),
    ("g", "[1]", ""),
]


@query("SELECT name, summary FROM " + _values([(n, s) for n, _, s in _SUMMARIES], "name, summary"))
def summary_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-81, O-82: each branch of the summary rule."""
    rows = _literal(spark, [(n, j) for n, j, _ in _SUMMARIES], "name string, j string")
    return rows.select("name", text.option_summary(F.parse_json("j")).alias("summary"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\x0B\r\n\f]+', ' ', 'g'), ' ') AS compacted FROM documents")
def compact_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-80: white space of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("compacted"))


_NAMES = [("git", "", "2.51", "man"), ("hello-2.12", "x", "2.12", "out"), ("", "pn", "", ""), ("a", "b", "1", "dev")]


@query("""
    WITH rows AS (SELECT p_name AS attr, p_brand AS pname, p_size::VARCHAR AS version, p_type AS output FROM part
                  UNION ALL SELECT * FROM """ + _values(_NAMES, "attr, pname, version, output") + """),
    based AS (SELECT *, CASE WHEN attr <> '' THEN attr ELSE pname END AS base FROM rows)
    SELECT attr, version, output, base || CASE WHEN version = '' OR contains(base, version) THEN '' ELSE '-' || version END
           || CASE WHEN output IN ('', 'out') THEN '' ELSE '.' || output END AS name FROM based""")
def package_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-83: owner names."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("attr"), F.col("p_brand").alias("pname"), F.col("p_size").cast("string").alias("version"), F.col("p_type").alias("output"))
    rows = rows.unionByName(_literal(spark, _NAMES, "attr string, pname string, version string, output string"))
    return rows.select("attr", "version", "output", text.package_name(*[F.col(c) for c in ("attr", "pname", "version", "output")]).alias("name"))


_VERSIONS = [("foo-1.0-2",), ("hello-2.12-man",), ("nodash",), ("a-b-c",), ("-9",), ("x-",)]


@query(r"""
    WITH rows AS (SELECT p_name || '-' || p_size AS full_name FROM part UNION ALL SELECT full_name FROM """ + _values(_VERSIONS, "full_name") + r""")
    SELECT full_name, CASE WHEN regexp_matches(full_name, '^.+-[0-9]') THEN regexp_extract(full_name, '^(.+)-([0-9].*)$', 1) ELSE full_name END AS pname,
           regexp_extract(full_name, '^(.+)-([0-9].*)$', 2) AS version FROM rows""")
def name_version_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-85: name and version."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("full_name"))
    rows = rows.unionByName(_literal(spark, _VERSIONS, "full_name string"))
    pname, version = text.split_name_version(F.col("full_name"))
    return rows.select("full_name", pname.alias("pname"), version.alias("version"))


_PATHS = [("/store/abc-hello-1",), ("plain",), ("/a/-lead",), ("/a/b-c/",)]


@query(r"""
    WITH rows AS (SELECT DISTINCT url AS path FROM pages UNION ALL SELECT path FROM """ + _values(_PATHS, "path") + r"""),
    last AS (SELECT path, regexp_extract(path, '([^/]*)/*$', 1) AS base FROM rows)
    SELECT path, CASE WHEN instr(base, '-') > 1 THEN substr(base, 1, instr(base, '-') - 1) ELSE base END AS hash,
           CASE WHEN instr(base, '-') > 1 THEN substr(base, instr(base, '-') + 1) ELSE base END AS label FROM last WHERE path IS NOT NULL""")
def hash_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-84, O-87: hash and label of a path's last part."""
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).filter("path is not null").distinct()
    rows = rows.unionByName(_literal(spark, _PATHS, "path string"))
    return rows.select("path", text.hash_from_path(F.col("path")).alias("hash"), text.transitive_label(F.col("path"), F.lit("none")).alias("label"))


@query(r"SELECT page_id, '/' || substr(url, length(regexp_extract(url, '^[^/]*//[^/]*')) + 2) AS path FROM pages")
def relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: paths below a root, here an URL's host."""
    root = F.regexp_extract("url", r"^[^/]*//[^/]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", text.relative_path(root, F.col("url")).alias("path"))


_TREE_SQL = """
    SELECT '/' || r_name AS path, 'd' AS kind FROM region
    UNION ALL SELECT '/' || r_name || '/' || n_name, 'd' FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || s_name, 'r'
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey"""


@query(_TREE_SQL)
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11, O-89: a tree as rows of paths, level by level."""
    top = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), text.child_path(F.lit("/"), F.col("r_name")).alias("path"), F.lit("d").alias("kind"))
    nations = table(spark, sf_dir, "nation").join(top, F.col("n_regionkey") == F.col("id"))
    middle = nations.select(F.col("n_nationkey").alias("id"), text.child_path(F.col("path"), F.col("n_name")).alias("path"), F.lit("d").alias("kind"))
    suppliers = table(spark, sf_dir, "supplier").join(middle, F.col("s_nationkey") == F.col("id"))
    leaves = suppliers.select(F.col("s_suppkey").alias("id"), text.child_path(F.col("path"), F.col("s_name")).alias("path"), F.lit("r").alias("kind"))
    return top.select("path", "kind").unionByName(middle.select("path", "kind")).unionByName(leaves.select("path", "kind"))


@query("SELECT path, row_number() OVER (ORDER BY path, kind) - 1 AS place FROM (" + _TREE_SQL + ")")
def sorted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-71 to O-74: storage order, as numbers."""
    return global_index(tree_flatten(spark, sf_dir), ["path", "kind"], "place").select("path", "place")


@query("SELECT c_nationkey AS nation, arg_min(c_name, c_custkey) AS label FROM customer GROUP BY c_nationkey")
def first_wins_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63, O-102: the first row of a key names it."""
    return first_wins(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", F.col("c_name"), F.col("c_custkey"), "label")


@query("""SELECT n_name, coalesce(min(s_name), n_name) AS label FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000
    GROUP BY n_nationkey, n_name""")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-50: a label where there is one, else the name."""
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("s"))
    joined = table(spark, sf_dir, "nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("n_name", F.coalesce("s", "n_name").alias("label"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-51: keys not met yet."""
    met = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(met, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-54: keys that a list holds."""
    met = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(met, "c_custkey", "left_semi")


@query("""
    WITH RECURSIVE n AS (SELECT count(*) AS c FROM part),
    edges AS (SELECT p_partkey AS src, (5 * p_partkey) % c AS dst FROM part, n UNION ALL SELECT p_partkey, (p_partkey + c // 4) % c FROM part, n),
    found AS (SELECT 3::BIGINT AS node UNION SELECT dst FROM found JOIN edges ON src = node)
    SELECT node::BIGINT AS node FROM found""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-100: what a seed reaches, through cycles."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    n = parts.count()
    edges = parts.select("src", F.explode(F.array((5 * F.col("src")) % n, (F.col("src") + n // 4) % n)).alias("dst"))
    return reach(spark.range(3, 4).select(F.col("id").alias("node")), edges).select("node")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "s").when(F.col("p_size") % 7 == 0, "d").otherwise("r")
    return parts.select(
        F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"),
        kind.alias("kind"), (F.col("p_size") - 1).cast(SIZE).alias("size"), (F.col("p_size") % 2 == 1).alias("executable"),
        F.when(kind == "s", F.col("p_brand")).otherwise("").alias("target"), F.array("p_brand", "p_type").alias("packages"),
    )


_FILES_SQL = """
    WITH files AS (
        SELECT '/' || p_type || '/' || p_name || '/' || p_partkey AS path,
               CASE WHEN p_size % 5 = 0 THEN 's' WHEN p_size % 7 = 0 THEN 'd' ELSE 'r' END AS kind, p_size - 1 AS size, p_size % 2 = 1 AS executable,
               CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END AS target, p_brand || ',' || p_type AS packages FROM part)"""


@query(_FILES_SQL + " SELECT path, kind, size::BIGINT AS size, executable, target, packages FROM files")
def line_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-30, O-31: records as lines and back."""
    records = _files(spark, sf_dir).select(lines.encode_file().alias("line")).select(lines.decode_file(F.col("line")).alias("r")).select("r.*")
    return records.withColumns({"size": F.col("size").cast("bigint"), "packages": F.array_join("packages", ",")})


@query(_FILES_SQL + """ SELECT CASE kind WHEN 'd' THEN 'd' WHEN 's' THEN 'l' ELSE CASE WHEN executable THEN 'x' ELSE ' ' END END || ' '
    || CASE WHEN size > 0 THEN size::VARCHAR ELSE '-' END || chr(9) || path || chr(9) || replace(packages, ',', ', ') AS value FROM files""")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-25, O-94: display lines."""
    return _files(spark, sf_dir).select(file_text().alias("value"))


@query(_FILES_SQL + """ SELECT '{"path":"' || path || '","packages":["' || replace(packages, ',', '","') || '"],"size":' || size || ',"kind":"' || kind
    || '","executable":' || executable || CASE WHEN target = '' THEN '' ELSE ',"target":"' || target || '"' END || '}' AS value FROM files""")
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-26, O-47: JSON of file records; an empty target has no key."""
    return _files(spark, sf_dir).select(file_json().alias("value"))


@query("""SELECT '{"name":"' || p_name || '"' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ',"summary":"' || p_type || '"' END || '}' AS value FROM part""")
def render_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-24, O-26: JSON of options; an empty summary has no key."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("summary"))
    return rows.select(option_json().alias("value"))


@query("SELECT p_name || chr(9) || p_type || chr(9) || p_brand AS line, p_name AS name, p_type || chr(9) || p_brand AS summary FROM part")
def option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-32, O-91: option lines, cut at the first tab."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_name", "p_type", "p_brand").alias("line"))
    return rows.select("line", lines.decode_option(F.col("line")).alias("o")).select("line", "o.name", "o.summary")


@query("SELECT count(*) AS entries, count(DISTINCT p_name) AS files, (SELECT count(DISTINCT s_name) FROM supplier) AS owners FROM lineitem JOIN part ON l_partkey = p_partkey")
def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-27, O-67: raw and merged counts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    by_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    counts = by_part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count_distinct("p_name").alias("files"))
    owners = table(spark, sf_dir, "supplier").agg(F.count_distinct("s_name").alias("owners"))
    return counts.crossJoin(F.broadcast(owners))  # one row each


@query("SELECT p_name AS name, p_type AS path FROM part UNION ALL SELECT p_name, p_brand FROM part WHERE p_size > 25")
def union_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-77: two projections together, repeats kept."""
    parts = table(spark, sf_dir, "part")
    one = parts.select(F.col("p_name").alias("name"), F.col("p_type").alias("path"))
    return one.unionByName(parts.filter("p_size > 25").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path")))


@query("""WITH raw AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part)
    SELECT p_partkey, array_to_string(list_sort(list(DISTINCT substr(h, 2 * i - 1, 2))), ',') AS bytes
    FROM raw, unnest(range(1, length(h) // 2 + 1)) AS u(i) GROUP BY p_partkey""")
def key_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-22, O-92: the byte buckets of a key."""
    line = F.concat_ws("\t", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(text.key_bytes(line)), ",").alias("bytes"))


@query("""SELECT path, lag(path) OVER (PARTITION BY kind ORDER BY path) AS before FROM (""" + _TREE_SQL + ")")
def previous_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-34, O-70: each record beside the one before it, as delta coding sees them."""
    order = Window.partitionBy("kind").orderBy("path")
    return tree_flatten(spark, sf_dir).select("path", F.lag("path").over(order).alias("before"))
