"""Quality rules: repetition coverage by rolling hashes.

Words, lines and n-grams of a batch of texts are hashed in numpy. An n-gram that its text has had
before covers its words, and the share of the text's word characters that is covered decides; the
same holds for lines. The first of equal n-grams or lines covers nothing: it repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import Texts, again, chunks, mix, repeated, texts_of, whitespace_table, with_columns

#: Length of n-gram -> most percent of the word characters that n-grams found earlier in the text may cover.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of the characters of lines that stand in lines equal to an earlier one.
LINE_COVERAGE = 30
SYMBOLS = b"#*$%&|<>"
MEASURES = (
    ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars"]
    + [f"dup_chars_{n}" for n in COVERAGE]
)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays."""
    batch, n = Texts(texts), len(texts)
    start, end, owner = batch.runs(whitespace_table())
    add = lambda at, value: np.bincount(at, value, n).astype(np.int64)
    chars = batch.span_chars(start, end)
    out = {"n_words": np.bincount(owner, minlength=n).astype(np.int64), "word_chars": add(owner, chars)}
    table = np.zeros(256, np.uint8)
    table[list(SYMBOLS)] = 1
    out["n_symbols"] = batch.per_text(table[batch.bytes])

    breaks = np.flatnonzero(batch.bytes == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    has_word = np.searchsorted(start, breaks) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], breaks[has_word]
    line_owner = np.searchsorted(batch.start, line_start, "right") - 1
    salt = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    keys = batch.span_hash(line_start, line_end) ^ salt[line_owner]
    later = again(keys)
    line_chars = batch.span_chars(line_start, line_end)
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n).astype(np.int64)
    out["line_chars"], out["dup_line_chars"] = add(line_owner, line_chars), add(line_owner[later], line_chars[later])

    words = batch.span_hash(start, end) ^ salt[owner]
    step = np.uint64(0x9FB21C651E98DF25)
    gram, at = words, np.arange(len(words))  # n-grams that may repeat, by their first word
    for size in range(2, max(COVERAGE) + 1):
        fits = at + size - 1 < len(words)
        at, gram = at[fits], gram[fits]
        fits = owner[at] == owner[at + size - 1]
        at, gram = at[fits], mix(gram[fits] * step + words[at[fits] + size - 1])
        if size < 3:
            continue
        found = repeated(gram)
        at, gram = at[found], gram[found]  # what starts with a unique n-gram is unique
        if size == 3 or size in COVERAGE:
            begin = at if size == 3 else at[again(gram)]
            mark = np.bincount(begin, minlength=len(words) + 1) - np.bincount(begin + size, minlength=len(words) + 1)
            covered = np.cumsum(mark)[: len(words)] > 0
            if size == 3:
                out["n_repeat_words"] = np.bincount(owner[covered], minlength=n).astype(np.int64)
            else:
                out[f"dup_chars_{size}"] = add(owner[covered], chars[covered])
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        parts = [measure(texts[a:b]) for a, b in chunks(texts)]
        yield with_columns(batch, {k: np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in MEASURES})


def _with_measures(docs: DataFrame) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return docs.mapInArrow(_measured, schema)


def judged(found: DataFrame) -> DataFrame:
    """Add base_failed and kept to measured rows."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = 100 * F.col("dup_line_chars") > LINE_COVERAGE * F.col("line_chars")
    for n, most in COVERAGE.items():
        bad = bad | (100 * F.col(f"dup_chars_{n}") > most * F.col("word_chars"))
    return found.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each document.

    A null or empty text has no words and fails. Other columns are dropped; repeated rows are judged
    alike; empty input gives an empty result.
    """
    return judged(_with_measures(docs.select("doc_id", "text"))).drop("text")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in (*MEASURES, "base_failed", "kept")}
    own = docs.withColumnsRenamed(clash)
    kept = judged(_with_measures(own)).filter("kept").select(*own.columns)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})
