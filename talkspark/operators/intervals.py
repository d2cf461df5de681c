"""Joins of spans on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions.scalars import overlap_ms
from talkspark.operators.places import dealt

#: Bucket width: a span falls into one bucket for each 30 s that it touches.
BUCKET_MS = 30_000


def in_buckets(df: DataFrame, start: str, end: str, width: int = BUCKET_MS) -> DataFrame:
    """df with a row for each bucket of its span; empty spans stand in the bucket of their start."""
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.floor((F.col(end) - 1) / width))
    return df.withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlap_join(spans: DataFrame, turns: DataFrame, keys: list[str], width: int = BUCKET_MS, parts: int | None = None) -> DataFrame:
    """Pairs of spans (start_ms, end_ms) and turns that share time, with overlap.

    turns gives turn_start, turn_end and other columns. An equi-join on keys and bucket; a pair that meets in
    several buckets counts in the one where the later of the two starts. A long recording is spread over its
    buckets, so it isn't one hot key. parts: as of dealt().
    """
    at = [*keys, "__bucket"]
    left = dealt(in_buckets(spans, "start_ms", "end_ms", width), parts, *at)
    right = dealt(in_buckets(turns, "turn_start", "turn_end", width), parts, *at)
    # the files of texts are small beside their words, which would be broadcast by that estimate
    pairs = left.join(right.hint("merge"), at)
    shared = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("turn_start"), F.col("turn_end"))
    pairs = pairs.withColumn("overlap", shared).where(F.col("overlap") > 0)
    home = F.floor(F.greatest("start_ms", "turn_start") / width)
    return pairs.where(F.col("__bucket") == home).drop("__bucket")


def best_by(value: str, *score: Column) -> Column:
    """The value with the greatest score, compared in order."""
    return F.max_by(value, F.struct(*score))
