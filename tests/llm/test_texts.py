"""Operators on single texts, URLs and pages."""

import collections
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from findloom.llm import html, kernels, linededup, quality, queries, simhash, toxicity, urlfilter
from findloom.llm import sentencepiece as pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b c a b c a b c", "é𝔞 é𝔞\né𝔞 é𝔞\n\n é𝔞", "#*$%&|<> x", "same\nsame\nsame", "w " * 30000, "x" * 50000, "a\x1cb a\u00a0b"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def many_texts():
    rng = random.Random(1)
    out = list(ODD)
    for _ in range(60):
        v = rng.choice((3, 10, 200))
        lines = [" ".join(f"w{rng.randrange(v)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        out.append("\n".join(lines + lines[: rng.randint(0, 2)]))
    return out


def measured_by_force(text):
    text = text or ""
    words = WORD.findall(text)
    found = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    for n in (3, *quality.COVERAGE):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, covered = collections.Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if counts[g] > 1 if n == 3 else g in seen:
                covered |= set(range(i, i + n))
            seen.add(g)
        if n == 3:
            found["n_repeat_words"] = len(covered)
        else:
            found[f"dup_chars_{n}"] = sum(len(words[i]) for i in covered)
    seen, found["n_dup_lines"], found["line_chars"], found["dup_line_chars"] = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            found["line_chars"] += len(line)
            if line in seen:
                found["n_dup_lines"] += 1
                found["dup_line_chars"] += len(line)
            seen.add(line)
    base = found["n_words"] < 50 or 100 * found["n_repeat_words"] > 50 * found["n_words"]
    bad = 100 * found["dup_line_chars"] > quality.LINE_COVERAGE * found["line_chars"] or any(
        100 * found[f"dup_chars_{n}"] > most * found["word_chars"] for n, most in quality.COVERAGE.items()
    )
    return found | {"base_failed": base, "kept": not base and not bad}


def test_quality(spark):
    texts = many_texts()
    docs = documents(spark, texts)
    got = {r["doc_id"]: r.asDict() for r in quality.quality(docs).collect()}
    want = {i: {"doc_id": i} | measured_by_force(t) for i, t in enumerate(texts)}
    assert got == want
    clash = docs.withColumns({"kept": F.lit(7), "n_words": F.lit("x")})
    kept = quality.keep_documents(clash)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in want.items() if x["kept"]]
    assert quality.quality(docs.limit(0)).count() == 0 and quality.keep_documents(docs.limit(0)).count() == 0


def test_kernels():
    texts = [b"ab ab", b"", b"xab"]
    batch = kernels.Texts(texts)
    start, end, owner = batch.runs(kernels.whitespace_table())
    h = batch.span_hash(start, end)
    assert owner.tolist() == [0, 0, 2] and h[0] == h[1] != h[2]
    keys = np.array([5, 3, 5, 5, 1], np.uint64)
    assert kernels.repeated(keys).tolist() == [True, False, True, True, False]
    assert kernels.again(keys).tolist() == [False, False, True, True, False]


def test_sentencepiece(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ["", None, "Hello world", "  two  spaces ", "▁ mark", "tab\tnew\nline", "日本語 テキスト 🙂\u200b", "a" * 3000, "</s> <unk> <0x41>", "\x00\x01", "x" + "é" * 500]
    texts += ["".join(rng.choice("ab eèüß.,-'1 \n漢🙂Z") for _ in range(rng.randint(1, 300))) for _ in range(80)]
    docs = documents(spark, texts)
    rows = pieces.encode(docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or ""), repr(t)
        assert got[i]["n_ids"] == len(got[i]["ids"]) and got[i]["lossless"] == ("▁" not in (t or ""))  # the mark decodes to a space
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows.select("doc_id", "ids")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if got[i]["lossless"])
    assert pieces.encode(docs.limit(0)).count() == 0


def table_urls():
    return [
        (None, "", ""), ("no scheme", "", ""), ("http://A.NET/x?y#z", "a.net", "/x"), ("http://net/", "net", "/"), ("http://b.net", "b.net", ""), ("x://y://z/p", "y:", "//z/p"),
        ("https://w.Example.net/en/1?q=/", "w.example.net", "/en/1"), ("https://example.net/fr/", "example.net", "/fr/"), ("http://a.org/fr/2#x", "a.org", "/fr/2"),
        ("http://example.com/de/3", "example.com", "/de/3"), ("http://notexample.com/de/3", "notexample.com", "/de/3"), ("ftp://h?x", "h", ""), ("http://h#/a", "h", ""), ("http://É.org/fr/", "É.org", "/fr/"),
    ]


def rule_by_force(host, path):
    fit = [(h, p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def test_url_rules(spark):
    rows = table_urls()
    df = spark.createDataFrame([(i, u, "<p>") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge_urls(df).collect()}
    for i, (_, host, path) in enumerate(rows):
        rule, verdict = rule_by_force(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict is None and got[i]["verdict"] == ("block" if got[i]["block_score"] >= 0.5 else "allow")
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_url_entropy(spark):
    urls = ["", None, "http://a", "HTTP://x.Org/~a|b|c", "http://例え.jp/😀😀é?x=1&y", "aaaa", "a$b.c*d\\e^f" * 300]
    df = urlfilter.with_parts(spark.createDataFrame([(u,) for u in urls], "url string"))
    for row in df.select("url", urlfilter._features()["entropy"].alias("e")).collect():
        text = row["url"] or ""
        assert abs(row["e"] + sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))) < 1e-9


def test_url_trees(spark):
    """Trees learn a lexical difference, on rows that no rule fits too."""
    rng = random.Random(3)
    urls = []
    for i in range(400):
        junk = i % 2
        tail = "".join(rng.choice("0123456789") for _ in range(30)) + "?a=1&b=2" if junk else "plain-words"
        host = ("x.net" if junk else "example.net") if i % 4 < 2 else "other.info"
        urls.append((i, f"http://{host}/{'' if junk else 'en/'}{tail}"))
    got = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    free = [i for i, _ in urls if i % 4 >= 2]
    assert np.mean([(got[i]["verdict"] == "block") == bool(i % 2) for i in free]) > 0.9


def test_boosting():
    """A tree's split is the best by force, and boosting separates what bins separate."""
    cells = [({k: 0 for k in urlfilter.BINS} | {"depth": d, "entropy": e}, float(4 * (d > 1)), 4.0) for d in range(4) for e in range(3)]
    prior, trees = urlfilter.train(cells)
    for bins, y, n in cells:
        assert (prior + sum(t.score(bins) for t in trees) > 0) == (y == n)
    assert urlfilter.train([c for c in cells if c[1]])[1] == []
    assert trees[0].feature == "depth" and trees[0].most == 1


def test_toxicity(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.93
    assert held.query("toxic == 1")["predicted"].mean() > 0.6


def test_toxicity_expressions():
    """Expressions by force: a byte, and what stands before it in the word."""
    texts = [b"Ab! cde", b"", "xé1".encode(), b"abcdefgh"]
    key, owner = toxicity.expressions(texts)
    want = []
    for i, t in enumerate(texts):
        for word in re.findall(rb"[a-z\x80-\xff]+", t.lower()):
            padded = b" " + word + b" "
            want += [(i, int.from_bytes(padded[max(0, k - 5) : k + 1], "big")) for k in range(1, len(padded))]
    assert list(zip(owner.tolist(), key.tolist())) == want


def test_toxicity_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 47, 5000))
    values = rng.normal(size=len(keys)).astype(np.float32)
    table = toxicity.Table(keys, values)
    got, found = table.find(np.concatenate([keys, keys + 1]))
    assert (got[: len(keys)] == values).all() and found[: len(keys)].all()
    assert (found[len(keys) :] == np.isin(keys + 1, keys)).all()
    assert not toxicity.Table(keys[:0], values[:0]).find(keys)[1].any()


def test_toxicity_probabilities(spark):
    """The tables hold Kneser-Ney log-likelihood differences, as computed by force."""
    texts = ["bad bad bad bat good"] * 4 + ["good bat goat good boat"] * 5 + ["other words"] * 2
    kinds = [1] * 4 + [0] * 5 + [None] * 2
    rows = collections.Counter(), collections.Counter(), collections.Counter()
    for t, k in zip(texts, kinds):
        keys = toxicity.expressions([t.encode()])[0].tolist()
        rows[2].update(keys)
        if k is not None:
            rows[k].update(keys)
    o, t, every = rows
    counts = spark.createDataFrame([(k, t[k], o[k]) for k in every], "key long, t long, o long")
    seen, history = toxicity._tables(counts)
    three = collections.Counter(k & 0xFFFFFF for k in every)
    single = np.bincount([x & 255 for x in three], minlength=256) + 0.1
    single = single / single.sum()
    d = toxicity.DISCOUNT

    def chance(c, key):
        same = [x for x in c if x >> 8 == key >> 8]
        n = sum(c[x] for x in same)
        left = sum(min(c[x], d) for x in same) / n if n else 1
        after = [x for x in three if x >> 8 == (key & 0xFFFFFF) >> 8]
        n2, part = sum(three[x] for x in after), sum(min(three[x], 0.75) for x in after)
        backoff = (max(three[key & 0xFFFFFF] - 0.75, 0) + part * single[key & 255]) / n2
        return max(c[key] - d, 0) / max(n, 1) + left * backoff

    for key in every:
        value, found = seen.find(np.array([key]))
        if not found[0]:
            value = history.find(np.array([key >> 8]))[0]
        assert value[0] == pytest.approx(np.log(chance(t, key) / chance(o, key)), abs=1e-5)


def test_toxicity_odd_tables(spark):
    docs = documents(spark, [None, "", "idiot", "fine"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, none).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs.unionAll(docs), one).count() == 8


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Big   &amp; bold</h1><p>One <b>two</b>
three&nbsp;four. It goes on for a while, as stories do.<p>Next paragraph &#8212; with a <a href=x>link</a> in it. It is long enough, too.
<div class="ad">Buy now</div><p>Last words of the story, which ends here.</p><section class="comments"><p>I liked it very much!</p></section></article>
<aside><p>Other stories</p></aside><form><p>Sign up</p></form><footer>&copy; Site</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain text only"), (5, "x", "<p>" * 3000 + "deep"), (None, "y", PAGE), (1, "u", PAGE), (6, "z", "<p a='" + "x" * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df).collect()
    story = "Big & bold One two three four. It goes on for a while, as stories do. Next paragraph — with a link in it. It is long enough, too. Last words of the story, which ends here."
    assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] == 1 or r["page_id"] is None] == [story] * 3
    assert all(r["n_chars"] == len(r["text"]) for r in got) and all(r["text"] == "" for r in got if r["page_id"] in (2, 3))
    assert html.extract(df.limit(0)).count() == 0


def test_html_pages(spark):
    """On pages of one make, the text is that of the article."""
    import html as entities

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.op9_html_extraction(spark, SF).collect()}
    for r in pages:
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?[bi]>", "", x))).strip() for x in re.split(r"</?(?:h1|p|br)>", body)]
        assert got[r["page_id"]] == " ".join(p for p in parts if p)


def test_viterbi_by_force():
    rng = np.random.default_rng(2)
    chain = html.Chain(rng.normal(size=(html.FEATURES, 2)), rng.normal(size=(2, 2)))
    rows = [rng.integers(0, html.FEATURES, 4).tolist() for _ in range(9)]
    e = chain.emissions(rows)
    best = max(range(1 << 9), key=lambda y: sum(e[i, y >> i & 1] for i in range(9)) + sum(chain.moves[y >> i & 1, y >> (i + 1) & 1] for i in range(8)))
    assert chain.decode(rows) == [best >> i & 1 for i in range(9)]


def test_crf_gradient():
    """A step goes up the log-likelihood."""
    rng = np.random.default_rng(3)
    rows, labels = [rng.integers(0, html.FEATURES, 5).tolist() for _ in range(7)], rng.integers(0, 2, 7).tolist()
    chain = html.Chain()

    def likelihood():
        e = chain.emissions(rows)
        every = [sum(e[i, y >> i & 1] for i in range(7)) + sum(chain.moves[y >> i & 1, y >> (i + 1) & 1] for i in range(6)) for y in range(1 << 7)]
        return every[sum(y << i for i, y in enumerate(labels))] - np.logaddexp.reduce(every)

    before = [likelihood()]
    for _ in range(10):
        chain.step(rows, labels, 0.3)
        before.append(likelihood())
    assert all(b > a for a, b in zip(before, before[1:]))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    sizes, first = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        sizes.append(len(rows))
        if name != "encode":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, out.schema)
        if name == "quality_rules":
            want = [r["doc_id"] for r in first.collect() if measured_by_force(r["text"])["kept"]]
            assert sorted(r["doc_id"] for r in rows) == sorted(want)
        if name == "near_dedup":
            assert simhash.near_duplicates(docs).filter("doc_id <> component_id").count() == 0
        if name == "line_dedup":
            assert linededup.dedup_report(docs).filter("n_dropped > 0").count() == 0
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    assert all(r["lossless"] for r in rows)
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["ids_sha256"] for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_are_whole(spark, name):
    found = queries.QUERIES[name](spark, SF)
    table = "pages" if name.startswith(("op7", "op9")) else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in found.select(key).collect()) == want


def test_html_implied_ends():
    """A head ends at what can't stand in it, and other hidden elements where HTML implies their end."""
    said = lambda page: [b.text for b in html.blocks_of(page)]
    head = "<html><head><title>t</title><meta charset=utf-8><style>x</style>"
    assert said(head + "<body><p>One<p>Two") == ["One", "Two"]
    assert said(head + "<div>One</div>") == ["One"] and said(head + "\n One <p>Two") == ["One", "Two"]
    assert said(head + "<template><p>no</p></template></head><body><p>One") == ["One"]
    assert said("<div><svg><path d=''><text>no</text><p>One</div>") == ["One"]
    assert said("<svg><foreignObject><p>no</p></foreignObject></svg><p>One") == ["One"]
    assert said("<form><select><option>no<select><p>One</form>") == ["One"]
    assert said("<div><button>no<button>no</button><p>One</div>") == ["One"]


def test_html_features_of_whole_blocks():
    """Hints, sentence ends and tokens count wherever they stand."""
    hashed = lambda page: html.features(html.blocks_of(page)[0], 0, 1, {})
    assert html._hash("hint all rights") in hashed(f"<p>{'longishword ' * 50} all rights reserved")
    assert html._hash("stops 3") in hashed(f"<p>{'word ' * 500} One. Two. Three.")
    assert html._hash("word sidebar") in hashed(f"<div class='{' '.join('abcdefghijklmn')} sidebar'>text</div>")
