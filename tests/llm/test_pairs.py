"""Operators on pairs, mixing and sharding against brute force."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.llm import common, fingerprints, linededup, mixing, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, sources=("a",)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def edited(rng, text, n):
    parts = text.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(12)] + [(900, 900 + i) for i in range(1, 60)] + [(7, 7)]
    want = groups(pairs, {x for a, b in pairs if a != b for x in (a, b)})
    cast = (lambda x: x) if kind == "long" else (lambda x: f"{x:04d}")
    edges = spark.createDataFrame([(cast(a), cast(b)) for a, b in pairs], f"a {kind}, b {kind}")
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert got == {cast(k): cast(v) for k, v in want.items()}
    assert common.connected_components(edges.filter("a is null")).count() == 0


def simhash_of(text):
    parts = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(spark):
    rng = random.Random(2)
    base = [words(rng, 200) for _ in range(8)]
    texts = [None, "", " \t", "One", "one", "ONE two", "Été É"] + base + [base[0]] * 30
    texts += [edited(rng, rng.choice(base[:3]), rng.choice((1, 1, 2, 6))) for _ in range(80)] + [words(rng, 20000)]
    prints = [simhash_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = groups(pairs, range(len(texts)))
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {k: r["component_id"] for k, r in got.items()} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_crowded_bucket(spark):
    """Many fingerprints that share a key: found by midpoints."""
    rng = random.Random(3)
    low = {0} | {sum(1 << b for b in rng.sample(range(38), rng.randint(1, 6))) for _ in range(150)}
    low |= {x ^ (1 << rng.randrange(38)) ^ (1 << rng.randrange(38)) for x in list(low)[:60]}
    prints = sorted(low)
    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    assert groups(got, prints) == groups(pairs, prints)


def shingles(line):
    """The five characters from each position on, or the whole of a shorter line."""
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def dropped_by_force(texts):
    spots = {}
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                spots.setdefault(line, []).append((d, n))
    lines = sorted(spots)
    sets = [shingles(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12]
    root = groups(pairs, range(len(lines)))
    first = {}
    for i, line in enumerate(lines):
        first[root[i]] = min(first.get(root[i], (10**9, 0)), min(spots[line]))
    gone = {}
    for i, line in enumerate(lines):
        for d, n in spots[line]:
            if (d, n) != first[root[i]]:
                gone.setdefault(d, []).append(n)
    return {d: sorted(gone.get(d, [])) for d in range(len(texts))}


def line_texts():
    rng = random.Random(4)
    base = [words(rng, 40) for _ in range(12)]
    hot = [edited(rng, base[0], rng.choice((0, 1, 1, 2, 3))) for _ in range(150)]
    passage = words(rng, 40)
    mixed = [words(rng, rng.randint(2, 12)) + " " + passage + " " + words(rng, rng.randint(0, 6)) for _ in range(90)]
    lines = base * 3 + hot + mixed + ["short", "short ", "a b", "", "   ", "The " * 50, "The " * 60, words(rng, 9000)]
    rng.shuffle(lines)
    texts = [None, "", "\n\n", "short\nshort\nshort"]
    while lines:
        n = rng.randint(1, 6)
        texts.append("\n".join(lines[:n]))
        lines = lines[n:]
    return texts


def test_line_dedup(spark):
    texts = line_texts()
    want = dropped_by_force(texts)
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in linededup.dedup_report(docs).collect()}
    assert {d: r["dropped"] for d, r in got.items()} == want
    count = lambda t: sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
    assert all(r["n_lines"] == count(texts[d]) and r["n_dropped"] == len(want[d]) for d, r in got.items())
    kept = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    for d, t in enumerate(texts):
        if want[d] and len(want[d]) == count(t):
            assert d not in kept
        else:
            left = t if not want[d] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d])
            assert kept[d]["text"] == left and kept[d]["n_chars"] == len(left or "")


def test_line_dedup_odd_rows(spark):
    """Null ids, repeated rows, clashing column names, no rows."""
    rows = [(None, "same line of text\nown one", 1), (3, "same line of text", 2), (3, "same line of text", 2), (5, "same line of text", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_no long")
    got = {r["doc_id"]: r["dropped"] for r in linededup.dedup_report(docs).collect()}
    assert got == {None: [0], 3: [], 5: [0]}
    kept = sorted(map(str, map(tuple, linededup.dedup_lines(docs).collect())))
    assert kept == ["(3, 'same line of text', 2)"] * 2 + ["(None, 'own one', 1)"]
    assert linededup.dedup_report(docs.filter("doc_id = 9")).count() == 0


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = ["", None, "one", "ab é𝔞 c", words(rng, 100), words(rng, 101), words(rng, 30000)] + ["same text here now and here again"] * 3
    ids = rng.sample(range(-5000, 90000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(ids)
    order = sorted(ids, reverse=True)
    by = dict(zip(ids, [t or "" for t in texts]))
    for at, i in enumerate(order):
        t, n = by[i], by[order[(at + 1) % len(order)]]
        half = len(t) // 2
        after = t[: len(t) - half] + n[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(after.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if after == t:
            assert got[i]["edited_fingerprint"] == got[i]["fingerprint"] and got[i]["near_edited"] == 1
    same = {got[i]["fingerprint"] for i, t in zip(ids, texts) if t and t.startswith("same")}
    assert len(same) == 1
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(docs.filter("text = 'one'")).collect()
    assert len(one) == 1


def test_next_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BITS", 1)
    monkeypatch.setattr(fingerprints, "BUCKET", 2)
    ids = random.Random(6).sample(range(10**12), 60)
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_syncmers_by_force(spark):
    """Anchors are the windows whose least inner hash stands at an edge, and shared passages share them."""
    rng = random.Random(7)
    passage = words(rng, 60, 10**6)
    docs = documents(spark, [words(rng, 50, 10**6) + " " + passage + " " + words(rng, 20, 10**6), words(rng, 5, 10**6) + " " + passage])
    anchors = fingerprints.anchors(docs).collect()
    first = {r["anchor"]: r["position"] for r in anchors if r["doc_id"] == 0}
    second = {r["anchor"]: r["position"] for r in anchors if r["doc_id"] == 1}
    shared = first.keys() & second.keys()
    assert len(shared) > 15 and {first[x] - second[x] for x in shared} == {45}
    assert 0.3 < len(second) / 61 < 0.7


def targets_by_force(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(8)
    sources = [rng.choice(["b", "a", "é", None, "c", "a", "a", "zero"]) for _ in range(400)]
    texts = [None if s == "zero" else words(rng, rng.choice((1, 5, 40))) if rng.random() > 0.05 else rng.choice((None, "", "  ")) for s in sources]
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.plan_mix(docs).collect()
    size = {s: sum(len(WORD.findall(t or "")) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    want = targets_by_force(size)
    assert len(got) == len(rows)
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]}
        assert abs(own[0]["target"] - want[s]) < 1e-6 and abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan_mix(docs.repartition(7)).collect()), key=str)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_curriculum(spark):
    """A source's demand up to each position is what its documents before it take."""
    docs = documents(spark, ["w " * 10] * 300, ["a", "b", "c"])
    rows = mixing.plan_mix(docs).collect()
    for source, slope in (("a", -0.5), ("b", 0.0), ("c", 0.5)):
        own = sorted((r["position"], r["taken"]) for r in rows if r["source"] == source and r["position"] is not None)
        assert len(own) == len({p for p, _ in own}) or source == "a"
        for t in (0.25, 0.5, 0.75):
            copies = 1 if source != "a" else max(1, sum(x for _, x in own) / 1000)
            share = sum(x for p, x in own if p <= t) / sum(x for _, x in own)
            if copies == 1:
                assert abs(share - ((1 - slope) * t + slope * t * t)) < 0.03


def test_mix_documents(spark):
    rng = random.Random(9)
    docs = documents(spark, [words(rng, rng.randint(1, 30)) for _ in range(200)] + [None, ""], ["a", "b", "c"])
    plan = {r["doc_id"]: r for r in mixing.plan_mix(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    by_source = lambda t: {s: sum(v for k, v in t.items() if plan[k]["source"] == s) for s in "abc"}
    wanted = by_source({k: r["taken"] for k, r in plan.items()})
    assert all(abs(by_source(taken)[s] - wanted[s]) <= 1 for s in wanted)
    twice = mixing.mix_documents(docs.unionAll(docs))
    assert twice.count() > 0


def test_lookup_table():
    owner = sharding.lookup_table()
    counts = np.bincount(owner)
    assert len(owner) == sharding.SLOTS and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = np.mean([a != b for a, b in zip(owner, fewer) if a != len(sharding.SHARDS) - 1])
    assert moved < 0.1
    for bad in (([], 7), (["a", "a"], 7), (["a"], 9), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    # Turns by force: in each, every shard takes the first free slot of its permutation.
    shards, slots = ("x", "y", "z"), 31
    number = lambda text: int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    order = [[(number(f"offset {s}") + k * (number(f"skip {s}") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    want = {}
    while len(want) < slots:
        for i in range(3):
            if len(want) < slots:
                want[next(p for p in order[i] if p not in want)] = i
    assert sharding.lookup_table(shards, slots) == [want[i] for i in range(slots)]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 50 else None, "x", 1) for i in range(500)], "doc_id long, shard string, slot int")
    got = sharding.assign_shards(df, "doc_id").collect()
    owner = sharding.lookup_table()
    for r in got:
        slot = 0 if r["doc_id"] is None else int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[owner[slot]])
    assert len(got) == 500 and sharding.assign_shards(df.limit(0), "doc_id").count() == 0
    sharding.write_shards(df.select("doc_id"), "doc_id", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    nulls = spark.createDataFrame([(None,) * 5] * 3, DOCS)
    assert simhash.near_duplicates(nulls).count() == 3 and simhash.keep_one(nulls).count() == 3
    assert mixing.plan_mix(nulls).count() == 3 and linededup.dedup_lines(nulls).count() == 3
    assert fingerprints.edited_fingerprints(nulls).count() == 3


def test_extra_columns(spark):
    docs = documents(spark, ["a b c", "a b c", "d"]).withColumns({c: F.lit("x") for c in ("n_words", "kept", "line", "k1", "size", "fp", "position")})
    assert simhash.keep_one(docs).count() == 2 and simhash.keep_one(docs).columns == docs.columns
    assert linededup.dedup_lines(docs).columns == docs.columns and mixing.mix_documents(docs).columns == docs.columns
    assert isinstance(simhash.near_duplicates(docs).schema["doc_id"].dataType, T.LongType)


def likeness_by_force(a, b):
    """Jaccard likeness of the character shingles at every position."""
    a, b = (frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in (a, b))
    return len(a & b) / len(a | b)


def test_line_dedup_changed_letters(spark):
    """Lines of ordinary length in which one letter differs, at a likeness of 0.8 or more."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
    texts = []
    for n in [8, 9, 10, 12, 15, 20, 25] * 12:
        line = " ".join(letters(rng.randint(4, 9)) for _ in range(n))
        at = rng.randrange(len(line))
        other = line[:at] + "X" + line[at + 1 :]
        if likeness_by_force(line, other) >= 0.8:
            texts += [line, other]
    assert len(texts) > 130
    got = {r["doc_id"]: r["dropped"] for r in linededup.dedup_report(documents(spark, texts)).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(len(texts))}


def test_line_dedup_long_words(spark):
    """Lines that differ behind the twelfth character of a word all stay."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"https://www.{digits(30)}" for _ in range(6)] + [f"sha256-common{digits(40)}" for _ in range(6)]
    texts += ["今日はとても良い天気ですね" + "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(30)) for _ in range(6)]
    texts.append(texts[-1][:-1] + "X")
    got = {r["doc_id"]: r["dropped"] for r in linededup.dedup_report(documents(spark, texts)).collect()}
    assert got == {i: [0] if i == 18 else [] for i in range(19)}


def test_materialize_leaves_no_shuffle_files(spark):
    """Shuffle files go with the query that wrote them, not when the driver collects its garbage."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data")}
    before = files()
    table = common.materialize(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "shuffled")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert table.count() == 700 and not left
    common.release(table)


def test_line_dedup_releases_texts(spark):
    """The table of all lines' texts and bands goes as soon as the candidates are known."""
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    tables = lambda: {x.name for x in folder.glob("findloom/lines-*")}
    common.materialize(spark.range(1), "lines-there")
    before = tables()
    report = linededup.dedup_report(documents(spark, ["one line of text here", "another text altogether", "one line of text here"]))
    assert before and tables() == before
    assert {r["doc_id"]: r["dropped"] for r in report.collect()} == {0: [], 1: [], 2: [0]}


def test_line_dedup_rows(spark):
    """Rows with null ids, or of one id with other texts, are documents of their own."""
    rows = [(None, "first unique line\nshared by these rows"), (None, "another one of its own\nshared by these rows"), (None, "no line in common")]
    rows += [(7, "shared by these rows\nseven's text"), (7, "a text apart\nwith its own second"), (8, "alone again\nwith its own second")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["text"] for r in linededup.dedup_lines(docs).collect()))
    assert kept == sorted(["first unique line", "another one of its own", "no line in common", "shared by these rows\nseven's text", "a text apart\nwith its own second", "alone again"])
    got = sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in linededup.dedup_report(docs).collect())
    assert got == sorted([("None", 2, [1]), ("None", 2, [1]), ("None", 1, []), ("7", 2, []), ("7", 2, []), ("8", 2, [1])])


def test_fingerprints_without_syncmers(spark):
    """Texts of 5 and 6 words have a fingerprint each, also where no window is a syncmer."""
    rng = random.Random(13)
    docs = documents(spark, [words(rng, 5 + i % 2, 10**6) for i in range(60)])
    got = [r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()]
    assert "" not in got and len(set(got)) == 60
    assert {r["doc_id"] for r in fingerprints.anchors(docs).collect()} == set(range(60))


def test_likeness_of_all_anchors(spark):
    """Likenesses are those of all anchors, also of long texts that share one passage or differ in one place."""
    rng = random.Random(14)
    passage, long = words(rng, 50, 10**6), words(rng, 4000, 10**6)
    parts = long.split(" ")
    parts[2000:2020] = words(rng, 20, 10**6).split(" ")
    texts = [words(rng, 3000, 10**6) + " " + passage, words(rng, 3000, 10**6) + " " + passage, long, " ".join(parts)]
    docs = documents(spark, texts)
    sets = {i: set() for i in range(4)}
    for r in fingerprints.anchors(docs).collect():
        sets[r["doc_id"]].add(r["anchor"])
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.edited_fingerprints(docs).collect()}
    want = {i: len(sets[i] & sets[(i - 1) % 4]) / len(sets[i] | sets[(i - 1) % 4]) for i in range(4)}
    assert got == pytest.approx(want) and 0 < got[1] < 0.05 and 0.98 < got[3] < 1


def test_line_dedup_stated_recall():
    missed = lambda likeness: (1 - likeness**linededup.ROWS) ** linededup.BANDS
    assert missed(0.8) < 0.003 and missed(0.9) < 2e-6


def test_clashing_names(spark):
    """Columns may have any names that the operators use for their own."""
    names = "id key row held hash first text_ planned copy left position size taken slope source_size __before __words __id __first __size __doc __key slot shard at owner gone n_lines own_id own_row in_row".split()
    rows = [(i, words(random.Random(i), 30), "s", *range(len(names))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    assert sorted(map(tuple, linededup.dedup_lines(docs).collect())) == sorted(rows)
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted(rows)
    assert sorted(map(tuple, mixing.mix_documents(docs).collect())) == sorted(rows)
    placed = sharding.assign_shards(docs, "doc_id")
    assert placed.count() == 4 and placed.columns == [c for c in docs.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    assert sharding.assign_shards(docs.select("slot", "key"), "slot").columns == ["slot", "key", "slot_", "shard"]


def test_line_dedup_shuffles_no_texts(spark):
    """The numbers of lines that go are broadcast, so that documents stay where they are."""
    texts = ["kept line of text\nanother line that stays", "kept line of text\nsomething else altogether", "no line in common"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = linededup.dedup_lines(documents(spark, texts))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: r["text"] for r in kept.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: texts[0], 1: "something else altogether", 2: texts[2]}
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_line_dedup_near_copies_below_threshold(spark, monkeypatch):
    """Of many lines that are alike, but not alike enough, few pairs are compared, and none that are enough is lost."""
    rng = random.Random(16)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(540))

    def changed(line, n):
        at = set(rng.sample(range(len(line)), n))
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if i in at else x for i, x in enumerate(line))

    texts = [changed(base, 10) for _ in range(100)]
    texts += [changed(x, 5) for x in texts[:10]]
    compared, verified = [], linededup._verified

    def counted(pairs, lines):
        compared.append(pairs.count())
        return verified(pairs, lines)

    monkeypatch.setattr(linededup, "_verified", counted)
    got = {r["doc_id"]: r["dropped"] for r in linededup.dedup_report(documents(spark, texts)).collect()}
    assert got == dropped_by_force(texts)
    assert sum(map(len, got.values())) >= 10 and sum(compared) < 1500


def test_line_dedup_parities_lose_no_pair(spark):
    """Pairs at or over the threshold are in reach by parities, and are found alike; the others aren't found alike."""
    rng = random.Random(17)
    texts = []
    for n in (3, 5, 12, 60, 300, 1500, 5000) * 6:
        line = "".join(rng.choice("abcdefgé𝔞 ") for _ in range(n))
        texts.append((line, edited(rng, line, rng.randint(0, 3)) + "x" * rng.randint(0, n // 6)))
        at = rng.randrange(n)
        texts.append((line, line[:at] + "X" * (n // 12 + 1) + line[at + n // 12 + 1 :]))
    likeness = [likeness_by_force(a, b) for a, b in texts]
    lines = spark.createDataFrame([(i, x) for i, pair in enumerate(texts) for x in [pair]], "k1 long, pair struct<a string, b string>")
    odd = lambda c: (lambda d: d.select(*[F.col(x).alias(x if x == "k1" else f"{x}{c}") for x in d.columns]))(linededup._parities(lines.select("k1", F.col(f"pair.{c}").alias("line"))))
    reach = {r["k1"] for r in odd("a").join(odd("b"), "k1").filter(linededup._reach("a", "b")).collect()}
    pairs = lines.select(F.col("k1").alias("a"), F.col("k1").alias("b"), F.lit("").alias("na"), F.lit("").alias("nb"), F.col("pair.a").alias("la"), F.col("pair.b").alias("lb"))
    alike = {r["a"] for r in pairs.mapInArrow(linededup._alike, "a bigint, b bigint, na string, nb string").collect()}
    assert alike == {i for i, x in enumerate(likeness) if x >= 0.8}
    assert alike <= reach and 20 < len(alike) < len(texts) - 10


def test_line_dedup_deals_bands_without_texts(spark, monkeypatch):
    """Buckets and marks are made without reading lines' texts."""
    plans, written = {}, linededup.materialize

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(linededup, "materialize", seen)
    texts = ["one line of text here", "one line of text here!", "another text altogether"]
    got = {r["doc_id"]: r["dropped"] for r in linededup.dedup_report(documents(spark, texts)).collect()}
    assert got == {0: [], 1: [0], 2: []}
    for tag in ("buckets", "members", "marks"):
        assert "FileScan" in plans[tag] and not re.search(r"\bline#", plans[tag])
