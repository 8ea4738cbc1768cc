"""Output forms: text lines and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import kind_char


def option_json() -> Column:
    return F.to_json(F.struct("name", F.nullif(F.col("summary"), F.lit("")).alias("summary")))


def file_json() -> Column:
    target = F.nullif(F.col("target"), F.lit("")).alias("target")
    return F.to_json(F.struct("path", "packages", "size", "kind", "executable", target))


def file_text() -> Column:
    """Kind, size (- for 0), path and owners."""
    size = F.when(F.col("size") > 0, F.col("size").cast("string")).otherwise("-")
    return F.concat(kind_char(F.col("kind"), F.col("executable")), F.lit(" "), size, F.lit("\t"), F.col("path"), F.lit("\t"), F.array_join("packages", ", "))


def render(rows: DataFrame, form: str) -> DataFrame:
    """Rows as they are (``rows``), or one column ``value`` of JSON (``json``) or text (``text``)."""
    if form == "rows":
        return rows
    if form not in ("json", "text"):
        raise ValueError(f"unknown form: {form}")
    option = "name" in rows.columns
    if form == "json":
        return rows.select((option_json() if option else file_json()).alias("value"))
    return rows.select(F.col("name").alias("value") if option else file_text().alias("value"))
