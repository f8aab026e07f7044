"""Line deduplication by overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines is hashed (two 64-bit hashes). Windows found more than once,
within a document or across documents, are repeated; their first occurrence, by document id and
then position, stays, and the lines that later occurrences cover are removed, each once,
as overlapping windows merge. The first occurrence of a hash is a minimum, pre-aggregated in
map tasks; occurrences meet it in a join by hash, which adaptive execution splits where one
window is very common. Only window hashes, not lines, are shuffled, until the removed
positions meet the texts.

Defined cases: lines are split at line feeds; a document of fewer than three lines has no window
and stays as it is, as does null text; a window without any word is none; a document whose
lines all go keeps its row, with empty text; rows that share both id and text are one document,
so they do not remove each other; a null id comes before all others; an empty table gives an
empty table; other columns are kept as they are, whatever their names, but for n_lines and
n_removed, which are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, let

WINDOW = 3


def _windows(lines: Column) -> Column:
    """array<at, h1, h2> of the windows that hold a word."""

    def hashed(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("at"),
            F.xxhash64(*part).alias("h1"),
            F.xxhash64(F.lit("window"), *reversed(part)).alias("h2"),
            F.rlike(F.concat(*part), F.lit(f"[^{WS_CLASS}]")).alias("words"),
        )

    n = F.size(lines)
    made = F.filter(F.transform(F.sequence(F.lit(0), n - WINDOW), hashed), lambda w: w["words"])
    return F.when(n >= WINDOW, made)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, starts: sorted places where later occurrences of repeated windows begin."""
    windows = docs.select("doc_id", "text_hash", F.explode(let(F.split("text", "\n", -1), _windows)).alias("w")).select("doc_id", "text_hash", "w.at", "w.h1", "w.h2")
    place = F.struct("doc_id", "text_hash", "at")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("found")).filter(F.col("found") > 1).select("h1", "h2", "first")
    later = windows.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def _kept(lines: Column, starts: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        before = F.slice(lines, acc["at"] + 1, F.greatest(s - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s + WINDOW).alias("at"), F.when(s > acc["at"], F.concat(acc["parts"], F.array(before))).otherwise(acc["parts"]).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<string>>)").alias("parts"))
    tail = lambda acc: F.flatten(F.concat(acc["parts"], F.array(F.slice(lines, acc["at"] + 1, F.size(lines)))))
    return F.aggregate(starts, zero, step, tail)


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """The rows of `docs`, their text without repeated windows, and, with `counts`, n_lines and n_removed, in place of columns of these names."""
    own = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    # the columns travel in a struct, so that no name of theirs can clash
    keyed = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("whole"), F.xxhash64("text").alias("text_hash"))
    marks = repeated_windows(keyed.select(F.col("key").alias("doc_id"), F.col("whole").alias("text"), "text_hash")).select(F.col("doc_id").alias("marked"), F.col("text_hash").alias("marked_hash"), "starts")
    met = keyed.join(marks, keyed["key"].eqNullSafe(F.col("marked")) & (F.col("text_hash") == F.col("marked_hash")), "left")

    def result(lines: Column) -> Column:
        return F.when(F.col("starts").isNull(), F.struct(F.size(lines).alias("n"), F.size(lines).alias("k"), F.col("whole").alias("text"))).otherwise(
            let(_kept(lines, F.col("starts")), lambda kept: F.struct(F.size(lines).alias("n"), F.size(kept).alias("k"), F.array_join(kept, "\n").alias("text")))
        )

    met = met.withColumn("made", let(F.split(F.coalesce("whole", F.lit("")), "\n", -1), result))
    kept = [F.col("made.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in own]
    if not counts:
        return met.select(*kept)
    return met.select(
        *kept,
        F.when(F.col("whole").isNull(), 0).otherwise(F.col("made.n")).cast("bigint").alias("n_lines"),
        F.when(F.col("whole").isNull(), 0).otherwise(F.col("made.n") - F.col("made.k")).cast("bigint").alias("n_removed"),
    )
