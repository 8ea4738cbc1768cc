"""Owner merge, first-wins distinct and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_owners(df: DataFrame, keys: Sequence[str], owner: str, out: str = "packages") -> DataFrame:
    """One row for each key, with its sorted distinct owners; empty and null owners go. ``owner`` is a text column."""
    named = df.filter((F.col(owner) != "") & F.col(owner).isNotNull())
    return named.groupBy(*keys).agg(F.sort_array(F.collect_set(owner)).alias(out))


def merge_records(records: DataFrame, keys: Sequence[str], drop_root: bool = True) -> DataFrame:
    """File records by key, with the owners of all; root and empty paths go, records without owners stay."""
    kept = records.filter(~F.col("path").isin("", "/")) if drop_root else records
    rows = kept.select(*keys, F.explode_outer("packages").alias("__owner"))
    owner = F.when(F.col("__owner") != "", F.col("__owner"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(owner)).alias("packages"))


def first_wins(df: DataFrame, key: str, value: Column, order: Column, out: str) -> DataFrame:
    """Of each key, the value of the row that comes first."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(out))


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """Distinct names (name, id) with ids in order, from 0."""
    from findloom.operators.ranges import global_index

    return global_index(df.select(F.col(name).alias("name")).distinct(), ["name"], "id")
