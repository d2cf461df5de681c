"""Sound samples of speakers: first lines, longest turns, montage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_lines(made: DataFrame, k: int = 3) -> DataFrame:
    """The first k lines of each speaker."""
    order = Window.partitionBy("job_id", "speaker").orderBy("start_ms", "line_no")
    return made.withColumn("hint_no", F.row_number().over(order)).where(F.col("hint_no") <= k)


def longest_turns(turns: DataFrame, k: int = 3, least_ms: int = 2000, most_ms: int = 12_000) -> DataFrame:
    """The k longest turns of each speaker, of those the ones of least_ms or more, cut at most_ms."""
    length = F.col("end_ms") - F.col("start_ms")
    order = Window.partitionBy("job_id", "speaker").orderBy(length.desc(), "turn_ix")
    out = turns.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where(length >= least_ms)
    return out.withColumn("end_ms", F.least("end_ms", F.col("start_ms") + most_ms))


def montage(turns: DataFrame, enough_ms: int = 8000, takes: int = 3, short_ms: int = 1500, cut_ms: int = 10_000) -> DataFrame:
    """Takes of each speaker, longest first, cut at cut_ms, until enough_ms are there and either `takes` takes are
    taken or the next is short; in time order."""
    length = F.col("end_ms") - F.col("start_ms")
    order = Window.partitionBy("job_id", "speaker").orderBy(length.desc(), "turn_ix")
    t = turns.withColumns({"place": F.row_number().over(order), "take_ms": F.least(length, F.lit(cut_ms))})
    t = t.withColumn("before", F.coalesce(F.sum("take_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.where(~((F.col("before") >= enough_ms) & ((F.col("place") > takes) | (F.col("take_ms") < short_ms))))
    t = t.withColumn("end_ms", F.col("start_ms") + F.col("take_ms"))
    in_time = Window.partitionBy("job_id", "speaker").orderBy("start_ms", "turn_ix")
    return t.withColumn("take_no", F.row_number().over(in_time)).drop("place", "before")
