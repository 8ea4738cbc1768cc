"""The operators' queries, one for each, and DuckDB twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html, linededup, mixing, quality, sentencepiece, sharding, simhash, toxicity, urlfilter
from .common import WORD, documents, pages


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "position"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id"), "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(pages(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(pages(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(documents(spark, sf_dir))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
}

def _mixing_sql() -> str:
    pick = lambda values: "CASE (rank - 1) % 3 " + " ".join(f"WHEN {i} THEN {v!r}::DOUBLE" for i, v in enumerate(values)) + " END"
    return f"""
        WITH sizes AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                   md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
        sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sums),
        weighed AS (SELECT *, {pick(mixing.WEIGHTS)} AS weight, {pick(mixing.SLOPES)} AS slope, source_size * {mixing.MOST} AS cap,
                           sum(source_size) OVER ()::BIGINT AS total FROM ranked),
        summed AS (SELECT *, sum(weight) OVER () AS weights FROM weighed),
        levels AS (
            SELECT *, (total - coalesce(sum(cap) OVER before, 0)::BIGINT)::DOUBLE / (weights - coalesce(sum(weight) OVER before, 0)) AS level
            FROM summed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        last AS (SELECT *, first(CASE WHEN cap / weight > level THEN level END ORDER BY cap / weight <= level, cap / weight, rank) OVER () AS free FROM levels),
        targets AS (SELECT source, source_size, slope, CASE WHEN cap / weight <= level THEN cap::DOUBLE ELSE weight * free END AS target FROM last),
        placed AS (
            SELECT s.doc_id, s.size, t.*, floor(target + 0.5) AS words,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        passed AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(words / source_size), {mixing.MOST}) ELSE 0 END AS passes FROM placed),
        counted AS (SELECT *, (passes * size + greatest(0, least(size, words - passes * source_size - ahead)))::BIGINT AS taken FROM passed),
        shared AS (SELECT *, least(1.0::DOUBLE, (ahead + size / 2) / words) AS share FROM counted)
        SELECT doc_id, size, source, source_size, target, taken,
               CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN share
                    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS position
        FROM shared"""


def _sharding_sql() -> str:
    owner = ",".join(map(str, sharding.lookup_table()))
    return f"""
        WITH slots AS (SELECT doc_id, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.SLOTS}, 0)::INTEGER AS slot FROM documents),
        owners AS (SELECT string_split('{owner}', ',') AS owner)
        SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 4, '0') AS shard FROM slots, owners"""


def _quality_sql() -> str:
    sizes = (3, *quality.COVERAGE)
    gram = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER (PARTITION BY rid ORDER BY pos)" for i in range(1, n))])
    grams = ", ".join(f"{gram(n)} AS g{n}" for n in sizes)
    found = ", ".join(
        f"g{n} IS NOT NULL AND " + (f"count(*) OVER (PARTITION BY rid, g{n}) > 1" if n == 3 else f"row_number() OVER (PARTITION BY rid, g{n} ORDER BY pos) > 1") + f" AS f{n}"
        for n in sizes
    )
    covered = ", ".join(f"bool_or(f{n}) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    dups = ", ".join(f"coalesce(sum(length(word)) FILTER (c{n}), 0)::BIGINT AS dup_chars_{n}" for n in quality.COVERAGE)
    measured = ", ".join(f"coalesce({m}, 0) AS {m}" for m in quality.MEASURES if m != "n_symbols")
    bad = " OR ".join([f"100 * dup_line_chars > {quality.LINE_COVERAGE} * line_chars", *(f"100 * dup_chars_{n} > {most} * word_chars" for n, most in quality.COVERAGE.items())])
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS words FROM docs),
        words AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
        grams AS (SELECT rid, pos, word, {grams} FROM words),
        found AS (SELECT rid, pos, word, {found} FROM grams),
        covered AS (SELECT rid, word, {covered} FROM found),
        by_word AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {dups} FROM covered GROUP BY rid),
        cut AS (SELECT rid, string_split(text, chr(10)) AS lines FROM docs),
        lines AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
        later AS (SELECT rid, length(line) AS size, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup
                  FROM lines WHERE regexp_matches(line, '{WORD}')),
        by_line AS (SELECT rid, sum(size)::BIGINT AS line_chars, count(*) FILTER (dup) AS n_dup_lines,
                    coalesce(sum(size) FILTER (dup), 0)::BIGINT AS dup_line_chars FROM later GROUP BY rid),
        measured AS (SELECT doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, {measured}
                     FROM docs LEFT JOIN by_word USING (rid) LEFT JOIN by_line USING (rid)),
        based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
        SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM based"""


ORACLE: dict[str, str] = {"op3_mixing": _mixing_sql(), "op5_sharding": _sharding_sql(), "op6_quality_rules": _quality_sql()}
