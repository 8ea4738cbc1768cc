"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks, the text between block-level tags. Features of a block are its
ancestor tags with the tokens of their class, id and role, and traits of its text; a chain of two labels,
article or other, is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import texts_of
from .pages_labelled import LABELLED

#: Pages of the table that are labelled by their markup for training, at most; the least hashes of their ids.
SAMPLE = 300
#: Features are hashed to so many weights.
FEATURES = 1 << 14
EPOCHS, RATE, PENALTY = 12, 0.5, 1e-4

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\s ]+")
#: Their content isn't text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
HIDDEN = {"head", "template", "svg", "select", "button", "object", "canvas", "math", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "acronym", "ruby", "rt", "rp"}
#: Tags that end an open element of the same kind, as authors leave their ends out.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Tags that can stand in a head; any other ends an open one.
HEAD = {"html", "head", "base", "link", "meta", "title", "style", "script", "noscript", "template", "noframes", "basefont", "bgsound"}
#: Tags of HTML that end open drawings and formulas.
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Tags that end other hidden elements.
ENDS = {"svg": BREAKOUT, "math": BREAKOUT, "select": {"input", "keygen", "textarea", "select"}, "button": {"button"}}
SCOPES = {"ul", "ol", "table", "dl", "div", "article", "section", "aside", "nav", "footer", "header", "main", "form", "body", "blockquote"}


class Block:
    __slots__ = ("text", "path", "links", "tag")

    def __init__(self, text: str, path: tuple[tuple[str, tuple[str, ...]], ...], links: int) -> None:
        self.text, self.path, self.links = text, path, links
        self.tag = next((t for t, _ in reversed(path) if t not in INLINE), "")


def _words(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        found += [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]
        if m[1].lower() in ("hidden", "aria-hidden") and value.lower() != "false":
            found.append("hidden")
    return tuple(dict.fromkeys(found))


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks with text, in page order; tags that were left open or are misplaced do no harm."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = hidden = anchors = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text))))
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden, anchors
        if any(t not in INLINE for t, _ in stack[to:]):
            flush()
        for t, _ in stack[to:]:
            hidden -= t in HIDDEN
            anchors -= t == "a"
        del stack[to:]

    def say(text: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and text.strip():
            pop(len(stack) - 1)
        if not hidden and text:
            held.append(text)
            if anchors:
                linked += len(text)

    while (m := _TOKEN.search(html, at)) is not None:
        say(html[at : m.start()])
        at = m.end()
        if m[1] is None:
            if m[0].startswith("<![CDATA["):
                say(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[1].lower()
        if html[m.start() + 1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if name in INLINE and stack[i][0] in SCOPES:
                    break
            if name in ("p", "br"):
                flush()
            continue
        if hidden:
            ended = ""
            for i in range(len(stack) - 1, -1, -1):
                kind = stack[i][0]
                if kind in ("template", "foreignobject", "desc"):
                    break
                if kind == "head" and name not in HEAD or name in ENDS.get(kind, ()):
                    pop(i)
                    ended = kind
                    break
            if ended == name == "select":
                continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else len(html)
            if name not in INLINE:
                flush()
            continue
        if name in CLOSES or name not in INLINE and name not in VOID:
            ends = CLOSES.get(name, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name not in INLINE:
            flush()
        if m[2].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        stack.append((name, _words(m[2])))
        hidden += name in HIDDEN
        anchors += name == "a"
    say(html[at:])
    flush()
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


_STOP = re.compile(r"[.!?…。]")
_HINTS = ("©", "copyright", "all rights", "cookie", "subscribe", "sign up", "log in", "advert", "sponsored", "comment", "share", "related", "read more", "newsletter", "privacy")


def features(block: Block, i: int, n: int, cache: dict[tuple, list[int]]) -> list[int]:
    """Hashed features of block i of n. Those of the path are remembered."""
    known = cache.get(block.path)
    if known is None:
        names: list[str] = ["bias"]
        for depth, (tag, words) in enumerate(reversed(block.path)):
            names += [f"in {tag}", *(f"word {w}" for w in words), *(f"{tag} {w}" for w in words)]
            if depth == 0:
                names.append(f"own {tag}")
        known = cache[block.path] = [_hash(x) for x in dict.fromkeys(names)]
    text = block.text
    words = text.count(" ") + 1
    share = block.links / max(1, len(text))
    traits = [
        f"tag {block.tag}",
        f"words {min(6, words.bit_length())}",
        f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
        f"stops {min(3, len(_STOP.findall(text)))}",
        f"place {min(4, 5 * i // max(1, n))}",
    ]
    if words < 60:
        low = text.lower()
        traits += [f"hint {h}" for h in _HINTS if h in low]
    return known + [_hash(x) for x in traits]


class Chain:
    """Weights (feature, label) and transitions; label 1 is article."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.weights = np.zeros((FEATURES, 2)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for r in rows for f in r), np.int64, sum(map(len, rows)))
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        return np.add.reduceat(self.weights[flat], starts, axis=0)

    def step(self, rows: list[list[int]], labels: list[int], rate: float) -> None:
        """One step up the log-likelihood's gradient, by forward and backward sums."""
        e, n = self.emissions(rows), len(rows)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = e[0]
        for i in range(1, n):
            forward[i] = e[i] + np.logaddexp(forward[i - 1, 0] + self.moves[0], forward[i - 1, 1] + self.moves[1])
        for i in range(n - 2, -1, -1):
            right = e[i + 1] + backward[i + 1]
            backward[i] = np.logaddexp(self.moves[:, 0] + right[0], self.moves[:, 1] + right[1])
        total = np.logaddexp(*forward[-1])
        error = -np.exp(forward + backward - total)
        error[np.arange(n), labels] += 1
        counts = np.repeat(np.arange(n), list(map(len, rows)))
        flat = np.fromiter((f for r in rows for f in r), np.int64, len(counts))
        self.weights *= 1 - rate * PENALTY
        np.add.at(self.weights, flat, rate * error[counts] / 8)
        moves = np.zeros((2, 2))
        for i in range(1, n):
            moves -= np.exp(forward[i - 1][:, None] + self.moves + (e[i] + backward[i])[None, :] - total)
            moves[labels[i - 1], labels[i]] += 1
        self.moves += rate * moves / 8

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi's best labels."""
        e = self.emissions(rows).tolist()
        (a, b), (c, d) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        x, y = e[0]
        for p, q in e[1:]:
            back.append((0 if x + a >= y + c else 1, 0 if x + b >= y + d else 1))
            x, y = max(x + a, y + c) + p, max(x + b, y + d) + q
        out = [0 if x >= y else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


#: Ancestors that are no part of an article, by tag or by a word of class, id or role.
_OTHER_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "figcaption"}
_OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "sidebar", "menu", "nav", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "consent", "notice", "banner", "comments", "comment", "share", "social", "related", "newsletter", "subscribe", "hidden"}


def markup_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by markup: article if an ancestor is ``article`` and none is of another kind; None without one."""
    if not any(t == "article" for b in blocks for t, _ in b.path):
        return None
    other = lambda t, words: t in _OTHER_TAGS or bool(_OTHER_WORDS & set(words))
    return [int(any(t == "article" for t, _ in b.path) and not any(other(*x) for x in b.path)) for b in blocks]


def train(htmls: list[str]) -> Chain:
    """A chain from the labelled pages of this package and from given pages that their markup labels.

    The package's pages, of many makes, weigh as much as the given ones. In a copy of each given page
    the tag ``article`` is a ``div``, so that the chain doesn't live on that tag alone.
    """
    own, given = [], []
    for page, wanted in LABELLED:
        blocks = blocks_of(page)
        own.append((blocks, [int(any(w in b.text for w in wanted)) for b in blocks]))
    for page in htmls:
        blocks = blocks_of(page)
        if (labels := markup_labels(blocks)) is not None and blocks:
            given.append((blocks, labels))
            plain = blocks_of(re.sub(r"(</?)article\b", r"\1div", page))
            if len(plain) == len(blocks):
                given.append((plain, labels))
    chain, cache = Chain(), {}
    ready = lambda pages: [([features(b, i, len(x), cache) for i, b in enumerate(x)], y) for x, y in pages if x]
    own, given = ready(own), ready(given)
    every = given + own * max(1, len(given) // max(1, len(own)))
    order = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(every)):
            chain.step(*every[k], RATE / (1 + epoch / 4))
    return chain


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars: the main text of each page's whole html, empty if it has none.

    Blocks are joined in page order by one space; within a block, character references are decoded and
    white space becomes one space. Null html is empty. Repeated rows stay; other columns are dropped;
    an empty table gives an empty result. Training reads ``SAMPLE`` pages at most; every page is decoded.
    """
    sample = pages.filter("html is not null and page_id is not null").select("page_id", "html")
    taken = sample.select("page_id", F.xxhash64("page_id").alias("h")).distinct().orderBy("h", "page_id").limit(SAMPLE)
    ids = [r["page_id"] for r in taken.collect()]
    rows = sample.filter(F.col("page_id").isin(ids) & (F.length("html") < 200_000)).orderBy("page_id").limit(SAMPLE).collect() if ids else []
    chain = train([r["html"] for r in rows])
    shared = pages.sparkSession.sparkContext.broadcast((chain.weights.astype(np.float32), chain.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, cache = Chain(*shared.value), {}
        for batch in batches:
            texts = []
            for page in texts_of(batch, "html"):
                blocks = blocks_of(page.decode("utf-8", "replace"))
                kept = ready.decode([features(b, i, len(blocks), cache) for i, b in enumerate(blocks)]) if blocks else []
                texts.append(" ".join(b.text for b, y in zip(blocks, kept, strict=True) if y))
                if len(cache) > 50_000:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    found = pages.select("page_id", "url", "html").mapInArrow(run, schema)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
