import json
import os
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findloom import api
from findloom.__main__ import parser, run
from findloom.errors import EngineIOError, InvalidDatabaseError, ManifestError, UsageError
from findloom.operators import closure as closing
from findloom.operators.closure import closure, labelled_entries
from findloom.operators.index import assign_blocks, postings, search_index
from findloom.plans import library_queries
from findloom.schemas import FILE, LISTING
from findloom.sources import crawl, http, manifests
from findloom.streaming.listings import merged, stream_listings

OPTIONS = """{"hello": {"loc": ["hello"], "type": "string", "description": "Example option."},
 "bye.a.b.c": {"loc": ["bye","a","b","c"], "type": "boolean", "description": {"text": "Whether to  enable\\n."}},
 "empty.first": {"loc": ["empty","first"], "type": "boolean", "description": ""},
 "obj.empty": {"loc": ["obj","empty"], "type": "string", "description": {"text": ""}},
 "null.type": {"loc": null, "type": null},
 "not.option": {"type": "string"}}"""


@pytest.fixture
def engine(spark):
    return api.Engine(spark)


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(content)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_options_json(engine, tmp_path):
    db = engine.options_from_json(write(f"{tmp_path}/o.json", OPTIONS))
    assert rows(db.search("bye", "text")) == [("bye.a.b.c",)]
    assert rows(db.search("e")) == [
        ("bye.a.b.c", "Whether to enable ."), ("empty.first", None), ("hello", "Example option."), ("null.type", None), ("obj.empty", "string"),
    ]
    assert rows(db.search("HELLO")) == [] and rows(db.search("%")) == []
    assert rows(db.search("first", "json")) == [('{"name":"empty.first"}',)]
    with pytest.raises(UsageError):
        db.search("")
    assert rows(db.search("", empty="legacy")) == []
    with pytest.raises(EngineIOError):
        engine.options_from_json(f"{tmp_path}/none.json")


def test_build_options(engine, tmp_path):
    mixed = write(f"{tmp_path}/o.json", OPTIONS)
    with pytest.raises(ManifestError, match="both"):
        engine.build(mixed, f"{tmp_path}/db")
    pure = json.loads(OPTIONS)
    del pure["not.option"]
    said = engine.build(write(f"{tmp_path}/p.json", json.dumps(pure)), f"{tmp_path}/db")
    assert said == {"kind": "options", "options": 5, "output": f"{tmp_path}/db"}
    db = engine.open(f"{tmp_path}/db", "options")
    assert db.kind == "options" and rows(db.search("hello")) == [("hello", "Example option.")]
    with pytest.raises(InvalidDatabaseError, match="packages"):
        engine.open(f"{tmp_path}/db", "packages")


@pytest.mark.parametrize(
    ("manifest", "strict", "documented"),
    [
        ([{"attr": "hello", "pname": "h", "version": "2.12", "outputs": {"out": "/p"}}, "/q", 5], [("hello-2.12", "/p")], None),
        ({"hello": "/p"}, [("hello", "/p")], None),
        ({"hello": {"path": "/p", "pname": "x", "version": "1"}}, [("hello-1", "/p")], None),
        ({"git": {"outputs": {"out": "/p", "man": "/q", "bad": 1}}}, [("git", "/p"), ("git.man", "/q")], None),
        ({"git": {"outputs": ["/p", "/q", None]}}, [("git", "/p"), ("git", "/q")], None),
        ({"git": {"path": "/o", "outputs": "/p"}}, [("git", "/o"), ("git", "/p")], None),
        ({"git": {"out": "/p", "man": "/q"}}, [], [("git", "/p"), ("git.man", "/q")]),
        ({"a": 1, "b": None, "c": {"path": ""}}, [], None),
        ([], [], None),
    ],
)
def test_manifest_shapes(spark, tmp_path, manifest, strict, documented):
    path = write(f"{tmp_path}/m.json", json.dumps(manifest))
    assert sorted(rows(manifests.manifest_outputs(spark, path))) == strict
    assert sorted(rows(manifests.manifest_outputs(spark, path, "documented"))) == (strict if documented is None else documented)


def test_manifest_scalar(spark, tmp_path):
    with pytest.raises(ManifestError):
        manifests.manifest_outputs(spark, write(f"{tmp_path}/m.json", '"x"'))


def test_build_packages(engine, tmp_path):
    for package in ("a", "b"):
        write(f"{tmp_path}/{package}/bin/tool", "x")
    write(f"{tmp_path}/a/share/own", "x")
    os.symlink("tool", f"{tmp_path}/a/bin/link")
    os.symlink("bin", f"{tmp_path}/a/folder")
    manifest = {"a": {"outputs": {"out": f"{tmp_path}/a"}}, "b": f"{tmp_path}/b/", "gone": f"{tmp_path}/none"}
    said = engine.build(write(f"{tmp_path}/m.json", json.dumps(manifest)), f"{tmp_path}/db")
    assert (said["kind"], said["paths"], said["outputs"]) == ("packages", 3, 2)
    db = engine.open(f"{tmp_path}/db")
    assert [(r["path"], r["packages"]) for r in db.search("/").collect()] == [("/bin/link", ["a"]), ("/bin/tool", ["a", "b"]), ("/share/own", ["a"])]
    assert rows(db.search("own", "text")) == [("  -\t/share/own\ta",)]
    with pytest.raises(ManifestError, match="no option"):
        engine.build(write(f"{tmp_path}/e.json", "{}"), f"{tmp_path}/db2")


XML = """<?xml version='1.0'?><items>
 <item attrPath="hello" system="x"><output name="out" path="/store/h1-hello-2.12"/><output name="man" path="/store/h2-hello-2.12-man"/></item>
 <item attrPath="again" system="x"><output name="out" path="/store/h1-hello-2.12"/></item>
 <item attrPath="gone" system="x"><output name="out" path="/store/h9-gone-1"/></item>
</items>"""


def crawled(tmp_path):
    c = f"{tmp_path}/cache"
    leaf = {"type": "regular", "size": 10, "executable": True}
    root = lambda **e: json.dumps({"root": {"type": "directory", "entries": e}})
    write(f"{c}/h1.ls", root(bin={"type": "directory", "entries": {"hello": leaf}}, l={"type": "symlink", "target": "bin"}))
    write(f"{c}/h2.ls", root(bin={"type": "directory", "entries": {"hello": leaf}}))
    write(f"{c}/h3.ls", json.dumps({"root": leaf}))
    write(f"{c}/h4.ls", "not json")
    write(f"{c}/h5.ls", root(lib={"type": "regular", "size": 7}, odd={"type": "socket"}))
    write(f"{c}/h1.narinfo", "StorePath: /store/h1-hello-2.12\nURL: nar/x\nReferences: h3-c-1 h1-hello-2.12 h4-d-1\n")
    write(f"{c}/h3.narinfo", "StorePath: /store/h3-c-1\r\nReferences: h1-hello-2.12 h5-e-1\r\n")
    write(f"{c}/h5.narinfo", "StorePath: /store/h5-e-1\nReferences: \n")
    return c, write(f"{tmp_path}/e.xml", XML)


def test_crawl(engine, spark, tmp_path):
    cache, xml = crawled(tmp_path)
    said = engine.crawl(api.CrawlOptions([("", xml)], cache), f"{tmp_path}/db")
    assert (said["files"], said["entries"]) == (2, 3)
    db = engine.open(f"{tmp_path}/db")
    assert db.kind == "index"
    assert [(r["path"], r["kind"], int(r["size"]), r["packages"]) for r in db.search("l").collect()] == [
        ("/bin/hello", "r", 10, ["hello", "hello.man"]), ("/l", "s", 0, ["hello"]),
    ]
    assert rows(db.search("zzzz")) == [] and len(rows(db.search("", empty="legacy"))) == 2
    said = engine.crawl(api.CrawlOptions([("", xml)], cache, follow_refs=True), f"{tmp_path}/all")
    assert (said["files"], said["entries"]) == (3, 5)  # the root that is a file counts, but isn't kept
    assert [(r["path"], r["packages"]) for r in engine.open(f"{tmp_path}/all").search("lib").collect()] == [("/lib", ["e-1"])]


def test_listing_rules(spark, tmp_path):
    cache, xml = crawled(tmp_path)
    got = crawl.read_enumeration(spark, xml).orderBy("ordinal").select("attr", "pname", "version", "output", "hash").collect()
    assert tuple(got[1]) == ("hello", "hello", "2.12-man", "man", "h2") and len(got) == 4
    infos = {r["hash"]: r for r in crawl.read_infos(spark, cache).collect()}
    assert infos["h1"]["references"] == ["h3", "h1", "h4"] and infos["h1"]["nar_url"] == "nar/x" and infos["h5"]["references"] == []
    write(f"{cache}/h8.ls.xz", "x")
    with pytest.raises(EngineIOError, match="h8"):
        crawl.read_listings(spark, cache)


def test_listing_batches():
    text = json.dumps({"root": {"type": "directory", "entries": {"f": {"type": "regular", "size": crawl.MAX_SIZE}}}})
    long = json.dumps({"root": {"type": "directory", "entries": {str(i): {"type": "symlink", "target": "t"} for i in range(crawl.ROWS)}}})
    texts = [text] * crawl.ROWS + [None, "no JSON", "[]", '{"root": 1}', long]
    batches = [pa.record_batch({"hash": [str(i) for i in range(len(texts))], "value": texts})]
    found = list(crawl.listing_batches(iter(batches)))
    assert [len(x) for x in found] == [crawl.ROWS] * 3 + [1]  # not one batch for each listing
    rows = [tuple(r.values()) for x in found for r in x.to_pylist()]
    assert rows[1] == ("0", "/f", "r", Decimal(crawl.MAX_SIZE), False, "") and rows[-1] == (str(len(texts) - 1), f"/{crawl.ROWS - 1}", "s", 0, False, "t")


def test_listings_dealt_out(spark, tmp_path):
    parts = spark.range(0, 200_000, 1, 1).select(F.col("id").alias("p_partkey"), F.sha2(F.col("id").cast("string"), 256).alias("p_name"), F.lit(1).alias("p_size"), F.lit("b").alias("p_brand"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    tasks = library_queries.listing_rows(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 2 * min(t["count"] for t in tasks)


def test_streaming(spark, tmp_path):
    cache, _ = crawled(tmp_path)
    labels = spark.createDataFrame([("h1", "one"), ("h2", "two"), ("h6", "six")], "hash string, label string")
    for _ in range(2):
        stream_listings(spark, cache, f"{tmp_path}/raw", f"{tmp_path}/cp").awaitTermination()
        write(f"{cache}/h6.ls", json.dumps({"root": {"type": "directory", "entries": {"l": {"type": "symlink", "target": "bin"}}}}))
    got = {r["path"]: r["packages"] for r in merged(spark, f"{tmp_path}/raw", labels).collect()}
    assert got == {"/bin/hello": ["one", "two"], "/l": ["one", "six"]}


def test_command_line(engine, tmp_path):
    path = write(f"{tmp_path}/o.json", OPTIONS)
    say = lambda *a: run(parser().parse_args(a), engine)
    assert say("opt", "--module-options", path, "bye") == ["bye.a.b.c"]
    assert say("--json", "opt", "--module-options", path, "hello") == ['{"name":"hello","summary":"Example option."}']
    with pytest.raises(SystemExit):
        parser().parse_args(["opt", "--module-options", path, "--db", path, "x"])
    with pytest.raises(UsageError):
        api.CrawlOptions([], "", scope="a", attrs=["b"])


def test_http_rules(tmp_path):
    waits, answers = [], []
    fetcher = http.Fetcher(str(tmp_path), lambda url, headers: answers.append(headers) or script.pop(0)(), waits.append)
    ok = lambda: http.Response(200, b"body", {"etag": "e"})
    code = lambda n: lambda: http.Response(n, b"", {})

    def broken():
        raise OSError("torn")

    script = [code(500), broken, ok]
    assert fetcher.fetch("u") == b"body" and waits[0] == http.LONG_WAIT and waits[1] < 1
    script = [code(304)]
    assert fetcher.fetch("u") == b"body" and answers[-1] == {"If-None-Match": "e"}
    script = [code(404)]
    assert fetcher.fetch("v") == b""
    script = [code(403)]
    with pytest.raises(EngineIOError):
        fetcher.fetch("v")
    script = [broken] * http.ATTEMPTS
    with pytest.raises(EngineIOError):
        fetcher.fetch("v")


def test_search_equals_scan(spark):
    random.seed(3)
    words = ["bin", "lib", "é", "share", "x", "conf", "𝔞", "doc"]
    files = sorted({"/" + "/".join(random.choices(words, k=random.randint(1, 5))) + str(random.randint(0, 99)) for _ in range(400)})
    records = spark.createDataFrame([(p, "r", Decimal(1), False, "", ["a"]) for p in files], FILE)
    placed = assign_blocks(records, 200).cache()
    parts = [p.cache() for p in postings(placed)]
    assert placed.select("block_id").distinct().count() > 20
    for q in ["bin/lib", "é/x", "é", "zzz", "/", "doc9", "𝔞/𝔞", "conf/conf/conf", "x1"]:
        got = sorted(r["path"] for r in search_index(placed, *parts, q).collect())
        assert got == [f for f in files if q in f], q


def test_closure_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "y"), ("b", None)], "src string, dst string")
    got = {r["node"]: r["depth"] for r in closure(spark.createDataFrame([("a",), ("a",), (None,)], "node string"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert closure(edges.filter(F.lit(False)).select(F.col("src").alias("node")), edges).count() == 0


def crawl_tables(spark, seen="/dev/null"):
    """Seed outputs, metadata and listings of a chain h0 to h9; each parsed piece of metadata leaves a line in a file."""

    def noted(batches):
        for batch in batches:
            with open(seen, "a") as file:
                file.write("x\n" * batch.num_rows)
            yield batch

    outputs = spark.createDataFrame([("a", "out", "h0", 1, 1), ("b", "man", "h0", 2, 0)], "attr string, output string, hash string, run int, ordinal int")
    infos = spark.createDataFrame([(f"h{i}", f"/store/h{i}-n{i}", [f"h{i + 1}"]) for i in range(10)], "hash string, store_path string, references array<string>")
    listings = spark.createDataFrame([(f"h{i}", "/f", "r", Decimal(i), False, "") for i in range(10)], LISTING)
    return outputs, infos.mapInArrow(noted, infos.schema), listings


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metadata_parsed_once(spark, tmp_path):
    found = labelled_entries(*crawl_tables(spark, f"{tmp_path}/seen"), follow_refs=True)
    assert sorted((int(r["size"]), r["packages"]) for r in found.collect()) == [(0, ["a"]), *((i, [f"n{i}"]) for i in range(1, 10))]
    with open(f"{tmp_path}/seen") as file:
        assert len(file.readlines()) <= 20  # at most twice each, however many rounds there are


def test_labels_not_broadcast(spark):
    found = labelled_entries(*crawl_tables(spark))
    assert [(int(r["size"]), r["packages"]) for r in found.collect()] == [(0, ["a"])]
    assert "BroadcastExchange" not in final_plan(found)


@pytest.mark.parametrize(("most", "sides"), [(20_000, {"BuildRight"}), (4, {"BuildRight"}), (0, set())])
def test_closure_edges_not_broadcast(spark, monkeypatch, most, sides):
    steps, write = [], closing.checkpointed
    monkeypatch.setattr(closing, "checkpointed", lambda df: (write(df), steps.append(df))[0])
    monkeypatch.setattr(closing, "BROADCAST", most, raising=False)
    edges = spark.range(40).select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 3 % 40, (F.col("id") + 9) % 40)).alias("dst"))
    got = {r["node"]: r["depth"] for r in closure(spark.range(1, 3).select(F.col("id").alias("node")), edges).collect()}
    depths, front = {1: 0, 2: 0}, [1, 2]
    while front:
        front = [depths.setdefault(x, depths[n] + 1) and x for n in front for x in (n * 3 % 40, (n + 9) % 40) if x not in depths]
    assert got == depths
    joins = [x for df in steps for x in final_plan(df).split("== Initial Plan ==")[0].splitlines() if "BroadcastHashJoin" in x]
    assert {side for x in joins for side in ("BuildLeft", "BuildRight") if side in x} == sides


def xml_item(name, extra=""):
    return f'<item attrPath="{name}" system="x">\n <output name="out" path="/store/h{name}-é&amp;-1"/>{extra}</item>'


@pytest.mark.parametrize("step", [1, 7, 97])
def test_enumeration_split(spark, tmp_path, step):
    names = [f"n{'é' * (i % 5)}{i}" for i in range(300)]
    path = write(f"{tmp_path}/e.xml", "<?xml version='1.0'?>\n<items>\n" + "<item attrPath='none'/>\n".join(map(xml_item, names)) + "\n</items>\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1000 + step))
        found = crawl.read_enumeration(spark, path)
        rows = found.orderBy("ordinal").select("attr", "store_path", F.spark_partition_id().alias("task")).collect()
        tasks = {r["task"] for r in found.select(F.spark_partition_id().alias("task")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r["attr"], r["store_path"]) for r in rows] == [(n, f"/store/h{n}-é&-1") for n in names]
    assert len(tasks) > 10  # one file isn't one task


@pytest.mark.parametrize(
    "inner",
    [
        f"<!-- {xml_item('no')} -->{xml_item('a')}", xml_item("a", "<!-- </item> -->"), xml_item("a", "<![CDATA[</item>]]>"), xml_item("a", xml_item("c")), xml_item("a", "<item/>"),
        xml_item("a").replace("</item>", "</item >"), f"<itemx attrPath='q'><output name='out' path='/no'/></itemx>{xml_item('a')}", xml_item("a", "<itemx/>"),
        f"{xml_item('a')}<?p <item attrPath='q'></item> ?>", "<item attrPath='/>'\r\n/><item/>" + xml_item("a", "<meta name='d' value='> &lt;item >'/> words > "),
    ],
)
def test_enumeration_markup(spark, tmp_path, inner):
    path = write(f"{tmp_path}/e.xml", f"<items>{inner}{xml_item('b')}</items>")
    listed = lambda items: sorted((r["_attrPath"], r["_system"], *map(tuple, r["output"])) for r in items.collect() if r["output"])
    whole = spark.read.format("xml").schema(crawl._ITEM).option("rowTag", "item").load(path)
    assert listed(crawl._items(spark, path)) == listed(whole) == [(n, "x", ("out", f"/store/h{n}-é&-1")) for n in "ab"]
