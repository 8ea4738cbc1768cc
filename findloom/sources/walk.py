"""Files below output directories."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import relative_path


def existing(outputs: DataFrame) -> DataFrame:
    """The outputs (name, path) whose path is a directory; others go without a word."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[bool(p) and os.path.isdir(p) for p in batch["path"]]]

    return outputs.select("name", "path").mapInPandas(keep, "name string, path string")


def walk(outputs: DataFrame) -> DataFrame:
    """name, root and file of each regular file and link to a file below each output; links to directories aren't followed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, root in zip(batch["name"], batch["path"], strict=True):
                for folder, _, files in os.walk(root, followlinks=False):
                    found = [os.path.join(folder, f) for f in files]
                    if found:
                        yield pd.DataFrame({"name": name, "root": root, "file": found})

    return outputs.select("name", F.rtrim("path", F.lit("/")).alias("path")).mapInPandas(run, "name string, root string, file string")


def package_files(outputs: DataFrame) -> DataFrame:
    """path (from the output's root) and package of each file."""
    files = walk(existing(outputs)).select(relative_path(F.col("root"), F.col("file")).alias("path"), F.col("name").alias("package"))
    return files.filter("path <> '/'")
