"""Tab-separated lines of file and option records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findloom.schemas import MAX_SIZE, SIZE


def _size(text: Column) -> Column:
    value = F.when(F.rlike(text, F.lit(r"^[0-9]{1,20}$")), text.try_cast(SIZE))
    return F.when(value <= F.lit(str(MAX_SIZE)).cast(SIZE), value).otherwise(F.lit(0).cast(SIZE))


def decode_file(line: Column) -> Column:
    """A file record of a line: path, kind, size, executable, target, owners; or path and owners alone. NULL for a line without a tab."""
    parts = F.split(line, "\t", -1)
    wide = F.size(parts) >= 6
    at = lambda i: F.get(parts, F.lit(i))
    owners = F.filter(F.split(F.when(wide, at(5)).otherwise(at(1)), ","), lambda x: x != "")
    record = F.struct(
        at(0).alias("path"),
        F.when(wide & at(1).isin("d", "s"), at(1)).otherwise("r").alias("kind"),
        F.when(wide, _size(at(2))).otherwise(F.lit(0).cast(SIZE)).alias("size"),
        (wide & (at(3) == "1")).alias("executable"),
        F.when(wide, at(4)).otherwise("").alias("target"),
        owners.alias("packages"),
    )
    return F.when(F.size(parts) >= 2, record)


def encode_file() -> Column:
    """The line of a file record's columns."""
    flag = F.when(F.col("executable"), "1").otherwise("0")
    return F.concat_ws("\t", "path", "kind", F.col("size").cast("string"), flag, F.coalesce("target", F.lit("")), F.array_join("packages", ","))


def decode_option(line: Column) -> Column:
    """name and summary, cut at the first tab; an empty or missing summary is NULL."""
    tab = F.instr(line, "\t")
    summary = F.when(tab > 0, F.nullif(F.substr(line, tab + 1), F.lit("")))
    return F.struct(F.substring_index(line, "\t", 1).alias("name"), summary.alias("summary"))


def encode_option() -> Column:
    return F.concat(F.col("name"), F.lit("\t"), F.coalesce("summary", F.lit("")))
