"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

A text is read once and leaves a narrow row: id, place and SHA-256 of the
normalised text.  Everything after works on these rows.

*First pass.*  Every row sets ``PROBES`` slots of a distributed counting Bloom
filter; a slot's hits are counted with map-side combine, and only slots hit
more than once stay.  Packed as bits of 64-bit words they are the filter of
possibly repeated hashes.

*Second pass.*  Every row looks its slots up in that filter, which all tasks
hold.  A row with a slot that is not set is the only one with its text and
passes straight through.  The rest (repeated ones and the filter's false
positives) are shuffled by their hash and grouped exactly.

The filter has at most ``filter_bits`` bits, whatever the corpus: the slots of
a larger counting filter are folded onto it.  With more repeated hashes than it
can tell apart, more rows take the exact way; the result is the same.

Defined results: a null text counts as empty; texts are equal if identical
after lower-casing A-Z only (told by SHA-256); the row with the largest id
stays, a null id being smaller than any; of rows equal in id and text, one
stays and all name the same ``keep_id``; an empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

PROBES = 2
WORD = 64            # bits of a word of the filter
LARGE = 10_000       # a group with more than one in so many rows is joined apart


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def slots(digest: Column, bits: int) -> list[Column]:
    """The slots of a hash in a filter of ``bits`` (a power of two) slots."""
    return [F.xxhash64(digest, F.lit(probe)).bitwiseAND(F.lit(bits - 1)) for probe in range(PROBES)]


def power_of_two(n: int) -> int:
    return 1 << max(6, (n - 1).bit_length())


def repeated_filter(rows: DataFrame, slot_bits: int, filter_bits: int) -> DataFrame:
    """``word, bits``: the slots that two rows or more have hit, folded onto
    ``filter_bits`` bits."""
    hits = rows.select(F.explode(F.array(*slots(F.col("digest"), slot_bits))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") > 1)
    folded = F.col("slot").bitwiseAND(F.lit(filter_bits - 1))
    return (twice.select(F.shiftright(folded, 6).alias("word"),
                         F.expr(f"shiftleft(1L, cast(slot & {WORD - 1} as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def flagged(rows: DataFrame, words: DataFrame, filter_bits: int) -> DataFrame:
    """``rows`` with ``suspect``: all its slots are set.  ``words`` has at most
    ``filter_bits / 64`` rows, so that every task can hold it."""
    held = F.broadcast(words)
    hit = F.lit(True)
    for probe, slot in enumerate(slots(F.col("digest"), filter_bits)):
        rows = (rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
                .join(held.select(F.col("word").alias("_word"), F.col("bits").alias(f"_bits{probe}")), "_word", "left")
                .withColumn(f"_hit{probe}", F.expr(f"coalesce(getbit(_bits{probe}, cast(_slot & {WORD - 1} as int)), 0) = 1"))
                .drop("_word", "_slot", f"_bits{probe}"))
        hit = hit & F.col(f"_hit{probe}")
    return rows.withColumn("suspect", hit).drop(*(f"_hit{probe}" for probe in range(PROBES)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 64,
                     filter_bits: int = 1 << 26) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    ``slots_per_row``: room of the counting filter; ``filter_bits`` (a power of
    two): most bits of the filter that goes to every task, 8 MB of them.
    """
    if filter_bits & (filter_bits - 1) or filter_bits < WORD:
        raise ValueError("filter_bits must be a power of two, 64 at least")
    common.prepare(docs.sparkSession)
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    # the place tells rows with one id apart; it is settled by the write
    rows = common.staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"),
                                     F.monotonically_increasing_id().alias("place")), "digests")
    n = rows.count()
    slot_bits = power_of_two(n * slots_per_row)
    filter_bits = min(slot_bits, filter_bits)
    words = common.staged(repeated_filter(rows, slot_bits, filter_bits), "repeated")
    told = flagged(rows, words, filter_bits)
    once = told.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest")

    suspects = common.staged(told.where("suspect").drop("suspect"), "suspects")
    groups = common.staged(
        suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "place")).alias("keep"),
                                       F.count(F.lit(1)).alias("group_size")), "groups")
    # at most LARGE groups hold more than one in LARGE rows each
    large = F.broadcast(groups.where(F.col("group_size") * LARGE > n))
    small = groups.where(F.col("group_size") * LARGE <= n)
    of_large = suspects.join(large, "digest")
    of_small = suspects.join(large.select("digest"), "digest", "left_anti").join(small, "digest")
    grouped = of_large.unionByName(of_small).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("place") == F.col("keep.place")).alias("kept"), "digest")
    return once.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept",
                                            F.lower(F.hex("digest")).alias("text_sha256"))
