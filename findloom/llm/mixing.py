"""Mixing sources to target weights, along a time-varying curriculum.

Each source has a weight and a schedule, the density of its share over training time [0, 1]. A source's
tokens are laid end to end in a hashed order; the schedule's integral is its cumulative demand, and
inverting it at a document's offset gives the document's time: its training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of each weight's schedule 1 + slope * (2t - 1): heavy sources fade, light ones come late.
SLOPES = (-0.5, 0.0, 0.5)
#: No source gives more than so many times its words.
MOST = 3
#: Hex digits of the order key that split a source for its running sums: 4,096 parts.
SPLIT = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size).

    Sources by code point, nulls last, weigh 5, 2, 1 and again. Shares follow the weights and add up
    to all words; a target over three times its source's words stops there, and what it leaves is
    shared again by weight. The windows here run over one row per source, sums of what map tasks have
    added up, not over documents.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("__rank") - 1) % len(values) + 1)
    found = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("__rank", rank)
        .withColumn("weight", pick(WEIGHTS))
        .withColumn("slope", pick(SLOPES))
        .withColumn("__cap", F.col("source_size") * MOST)
        .withColumn("__total", F.sum("source_size").over(every))
        .withColumn("__weights", F.sum("weight").over(every))
    )
    order = Window.orderBy(F.col("__cap") / F.col("weight"), "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn(
        "__level",
        (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        / (F.col("__weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("__capped", F.col("__cap") / F.col("weight") <= F.col("__level"))
    found = found.withColumn(
        "__last",
        F.min(F.when(~F.col("__capped"), F.struct((F.col("__cap") / F.col("weight")).alias("r"), "__rank", "__level"))).over(every),
    )
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("weight") * F.col("__last.__level"))
    return found.select("source", "source_size", "weight", "slope", target.alias("target"))


def _time(share: Column, slope: Column) -> Column:
    """Invert the demand: the t in [0, 1] at which (1 - slope) t + slope t^2 reaches ``share``."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def plan_mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, position.

    ``size`` is the number of words (null text: 0). A source whose target is q times its words and some
    more gives q whole passes, then its documents in hashed order until the target is met to the word:
    the last one is cut. ``position`` is the time of the first copy, null where nothing is taken.
    Repeated rows are documents of their own; a null doc_id orders as an empty one. A source's running
    sums are split in 4,096 parts by the hash, so that one source may hold any share of the rows.
    Empty input gives an empty result.
    """
    sizes = materialize(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
        ),
        "sizes",
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.select("*", key.alias("__key")).withColumn("__part", F.substring("__key", 1, SPLIT))
    parts = keyed.groupBy("source", "__part").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "__part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    facts = parts.join(source_targets(sizes).withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    facts = facts.withColumnsRenamed({"source": "__source", "__part": "__facts_part"})
    inside = Window.partitionBy("source", "__part").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        facts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__facts_part"))
    )
    words = F.floor(F.col("target") + 0.5)
    before = F.col("__ahead") + F.col("__inside")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - F.col("__passes") * F.col("source_size")
    return (
        placed.withColumn("__before", before)
        .withColumn("__passes", F.least(passes, F.lit(MOST)))
        .withColumn(
            "taken",
            (F.col("__passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before")))).cast("bigint"),
        )
        .withColumn("__words", words)
        .withColumn("position", F.when(F.col("taken") > 0, copy_position(F.lit(0))))
        .select("doc_id", "size", "source", "source_size", "target", "taken", "position", "slope", "__before", "__words")
    )


def copy_position(copy: Column) -> Column:
    """Training position of the given copy (from 0) of a planned row."""
    offset = copy * F.col("source_size") + F.col("__before") + F.col("size") / 2
    return _time(F.least(F.lit(1.0), offset / F.col("__words")), F.col("slope"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it's taken, range-sorted by training position.

    Returns the columns of ``docs``; a source's last document may be cut to the words that its target
    still takes, with ``n_chars`` set anew if there is such a column; other columns stay, whatever their names.
    Documents without words are left out, as they add none. An empty table gives an empty result.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text", "source").cast("string"))
    plan = plan_mix(docs.select(key.alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("planned"))
    # Rows that are repeated share what is taken of them.
    plan = plan.agg(
        F.max("size").alias("size"),
        F.floor(F.sum("taken") / F.count("*")).alias("taken"),
        *[F.min(c).alias(c) for c in ("slope", "source_size", "__before", "__words")],
    ).filter("taken > 0")
    # Columns of the documents travel in a struct, so that no name of theirs meets one of these.
    held = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), "text")
    joined = held.join(plan, F.col("key") == F.col("planned"))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    copies = copies.withColumns({"left": left, "position": copy_position(F.col("copy"))})
    # The first words up to the cut, with the white space between them as it is.
    space = r"[\x20\x09-\x0D]"
    words = F.split(F.regexp_replace("text", f"^{space}+", ""), rf"(?<={space})(?=[^\x20\x09-\x0D])")
    cut = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("left").cast("int")), ""), f"{space}+$", "")
    copies = copies.withColumn("text", F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("text")))
    spread = copies.repartitionByRange("position", "key").sortWithinPartitions("position", "key")
    fields = {c: F.col("held").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in fields:
        fields["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return spread.select(*[fields[c].alias(c) for c in docs.columns])
