"""Schemas of the record types."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
#: Unsigned 64-bit numbers.
SIZE = T.DecimalType(20, 0)
MAX_SIZE = (1 << 64) - 1

OPTION = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("summary", T.StringType())])
#: kind: r (regular), d (directory) or s (symbolic link).
FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", SIZE),
        T.StructField("executable", T.BooleanType()),
        T.StructField("target", T.StringType()),
        T.StructField("packages", STRINGS),
    ]
)
#: What makes two file records one, but for their owners.
FILE_KEY = ["path", "kind", "size", "executable", "target"]
LISTING = T.StructType([T.StructField("hash", T.StringType()), *FILE.fields[:-1]])
OPTIONS, PACKAGES, INDEX = KINDS = "options", "packages", "index"
