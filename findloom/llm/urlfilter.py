"""URL filtering: block and allow rules, and gradient-boosted trees on lexical features.

The rules label the URLs that they fit; trees trained on those judge the rest. Features are put in a
few bins each, so that all labelled URLs, however many, add up to at most ``max_cells()`` distinct
cells: Spark counts the cells, the driver grows trees on the counts, and the trees are one SQL
expression inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Upper bounds of each feature's bins; a value above the last is in one more bin.
BINS = {
    "length": (24, 36, 48, 72, 120),
    "depth": (1, 2, 3, 5),
    "digit_ratio": (0.02, 0.06, 0.12, 0.25),
    "entropy": (3.4, 3.7, 4.0, 4.4),
    "parameters": (0, 1, 2),
    "suffix_rate": (0.1, 0.3, 0.5, 0.7, 0.9),
    "suffix_share": (0.001, 0.01, 0.1, 0.3),
}
#: Suffixes are hashed to so many rows of statistics.
SUFFIXES = 4096
#: A labelled URL's suffix rate is that of the labels in the other folds, so that it doesn't hold its own.
FOLDS = 5
ROUNDS, RATE, PENALTY = 40, 0.3, 1.0


def max_cells() -> int:
    return 2 * math.prod(len(x) + 1 for x in BINS.values())


def with_parts(urls: DataFrame) -> DataFrame:
    """Add host and path: null or without ``://``, both empty."""
    rest = F.regexp_extract("url", r"^(?s).*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def match(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _suffix() -> Column:
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIXES)).cast("int")


def _features() -> dict[str, Column]:
    """Features of the URL alone, JVM-side; entropy is that of all its characters, in bits."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    own = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(F.transform(own, lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c)))), F.lit(0.0), lambda x, y: x + y)
    return {
        "length": F.length(url),
        "depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
        "entropy": entropy,
        "parameters": F.when(F.instr(url, "?") > 0, F.length(F.regexp_replace(url, "[^=]", ""))).otherwise(0),
    }


def _bin(value: Column, bounds: Sequence[float]) -> Column:
    found = F.lit(len(bounds))
    for i, most in reversed(list(enumerate(bounds))):
        found = F.when(value <= most, F.lit(i)).otherwise(found)
    return found.cast("int")


@dataclass
class Tree:
    """One split on a feature's bin, and one below either side; a leaf has a value alone."""

    value: float
    feature: str = ""
    most: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(F.col(f"__bin_{self.feature}") <= self.most, self.low.column()).otherwise(self.high.column())

    def score(self, cell: dict[str, int]) -> float:
        if self.low is None:
            return self.value
        return (self.low if cell[self.feature] <= self.most else self.high).score(cell)


def grow(cells: list[tuple[dict[str, int], float, float]], depth: int) -> Tree:
    """The tree of Newton steps on cells of (bins, gradient, hessian)."""
    gain = lambda g, h: g * g / (h + PENALTY)
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, found = 1e-6, None
    for name, bounds in BINS.items() if depth else ():
        sums = [[0.0, 0.0] for _ in range(len(bounds) + 1)]
        for bins, a, b in cells:
            sums[bins[name]][0] += a
            sums[bins[name]][1] += b
        low_g = low_h = 0.0
        for i in range(len(bounds)):
            low_g, low_h = low_g + sums[i][0], low_h + sums[i][1]
            if low_h and h - low_h > 1e-9 and (now := gain(low_g, low_h) + gain(g - low_g, h - low_h) - gain(g, h)) > best + 1e-9:
                best, found = now, (name, i)
    if not found:
        return Tree(-g / (h + PENALTY) * RATE)
    name, most = found
    return Tree(0, name, most, grow([c for c in cells if c[0][name] <= most], depth - 1), grow([c for c in cells if c[0][name] > most], depth - 1))


def train(cells: list[tuple[dict[str, int], float, float]]) -> tuple[float, list[Tree]]:
    """Boosted trees for cells of (bins, blocked, all); without both classes, the prior alone."""
    blocked, every = sum(c[1] for c in cells), sum(c[2] for c in cells)
    prior = math.log((blocked + 1) / (every - blocked + 1))
    if not blocked or blocked == every:
        return prior, []
    score, trees = [prior] * len(cells), []
    for _ in range(ROUNDS):
        rate = [1 / (1 + math.exp(-x)) for x in score]
        tree = grow([(b, n * p - y, n * p * (1 - p)) for (b, y, n), p in zip(cells, rate, strict=True)], 3)
        trees.append(tree)
        score = [x + tree.score(c[0]) for x, c in zip(score, cells, strict=True)]
    return prior, trees


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of each row's url.

    The verdict is the longest fitting rule's, or block where the trees' probability is 1/2 or more.
    Null URLs have empty host and path and are judged like any other. Repeated rows stay; other columns
    are dropped; empty input gives an empty result. Two broadcasts, both bounded: ``SUFFIXES`` * (``FOLDS`` + 1) rows of
    statistics, and the trees, of 8 leaves each, inside the expression. What reaches the driver is
    ``max_cells()`` counts at most.
    """
    rule, verdict = match(rules)
    fold = F.when(verdict.isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS))).otherwise(-1).cast("int")
    found = with_parts(pages.select("page_id", "url")).withColumns({"rule": rule, "__rule_verdict": verdict, "__suffix": _suffix(), "__fold": fold})
    blocked = (F.col("__rule_verdict") == "block").cast("int")
    stats = found.groupBy("__suffix", "__fold").agg(F.coalesce(F.sum(blocked), F.lit(0)).alias("y"), F.count("__rule_verdict").alias("n"), F.count("*").alias("rows"))
    stats = stats.collect()  # SUFFIXES * (FOLDS + 1) rows at most
    total, sums = max(1, sum(r["rows"] for r in stats)), {}
    for r in stats:
        y, n, rows = sums.get(r["__suffix"], (0, 0, 0))
        sums[r["__suffix"]] = (y + r["y"], n + r["n"], rows + r["rows"])
    table = []
    for r in stats:  # of those without a label, y and n are 0: their rate is that of all labels
        y, n, rows = sums[r["__suffix"]]
        table.append((r["__suffix"], r["__fold"], (y - r["y"] + 1) / (n - r["n"] + 2), rows / total))
    table = pages.sparkSession.createDataFrame(table, "`__key` int, `__key_fold` int, `suffix_rate` double, `suffix_share` double")
    same = (F.col("__suffix") == F.col("__key")) & (F.col("__fold") == F.col("__key_fold"))
    featured = found.withColumns(_features()).join(F.broadcast(table), same, "left")
    binned = featured.select(
        "page_id", "host", "path", "rule", "__rule_verdict", *[_bin(F.col(k), v).alias(f"__bin_{k}") for k, v in BINS.items()]
    )
    rows = (
        binned.filter("__rule_verdict is not null")
        .groupBy(*[f"__bin_{k}" for k in BINS])
        .agg(F.sum((F.col("__rule_verdict") == "block").cast("int")).alias("y"), F.count("*").alias("n"))
        .collect()
    )
    cells = sorted((({k: r[f"__bin_{k}"] for k in BINS}, float(r["y"]), float(r["n"])) for r in rows), key=lambda c: tuple(c[0].values()))
    prior, trees = train(cells)
    margin = sum((t.column() for t in trees), F.lit(prior))
    scored = binned.withColumn("block_score", 1 / (1 + F.exp(-margin)))
    by_trees = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__rule_verdict", by_trees).alias("verdict"), "block_score")
