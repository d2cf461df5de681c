"""Chunk plans for transcription."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.operators import live

TARGET_MS, OVERLAP_MS = 90_000, 2_000


def fixed_chunks(spans: DataFrame, target_ms: int = TARGET_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """(job_id, chunk_ix, start_ms, end_ms) of spans (job_id, start_ms, end_ms): steps of target less overlap, the last
    chunk ends with the span."""
    step = max(1, target_ms - overlap_ms)
    n = F.greatest(F.lit(1), F.ceil((F.col("end_ms") - F.col("start_ms") - overlap_ms) / step)).cast("int")
    c = spans.where("end_ms > start_ms").select("job_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk_ix", "k"))
    return c.select("job_id", "chunk_ix", (F.col("s") + F.col("k") * step).alias("start_ms"), F.least(F.col("s") + F.col("k") * step + target_ms, F.col("e")).alias("end_ms"))


def plan_chunks(turns: list[tuple[int, int]], duration: int, target: int = TARGET_MS, overlap: int = OVERLAP_MS) -> list[tuple[int, int]]:
    """Chunks that cover 0..duration without a gap, none over target.

    A chunk begins with the first turn and grows turn by turn while it stays within target; the next one begins `overlap`
    before its end, so no word is cut in both. Silence before the first turn is a chunk of its own, silence after the
    last one another, with overlap; what is still too long is cut into fixed steps, and so is a recording without turns.
    """
    return list(each_chunk(sorted(turns), duration, target, overlap))


def each_chunk(ordered: Iterable[tuple[int, int]], duration: int, target: int = TARGET_MS, overlap: int = OVERLAP_MS) -> Iterator[tuple[int, int]]:
    """plan_chunks of turns in order, one at a time."""
    step = max(1000, target - overlap)

    def grown() -> Iterator[tuple[int, int]]:
        start, reach = None, 0
        for a, b in ordered:
            a, b = max(0, a), min(b, duration)
            if b <= a:
                continue
            if start is None:
                if a > 0:
                    yield 0, a
                start = reach = a
            elif b - start > target and reach > start:
                yield start, reach
                start = max(0, reach - overlap)
            reach = max(reach, b)
        if start is not None:
            yield start, reach
        if reach < duration:
            yield (0 if start is None else max(0, reach - overlap)), duration

    for a, b in grown():
        while b - a > target:
            yield a, a + target
            a += step
        yield a, b


def turn_chunks(turns: DataFrame, durations: DataFrame, target_ms: int = TARGET_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """plan_chunks for each job of durations (job_id, duration_ms): greedy within a job, turn by turn."""
    rows = durations.select("job_id", "duration_ms").join(turns.select("job_id", "start_ms", "end_ms"), "job_id", "left")

    def each(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        first = next(group)
        own = ((int(a), int(b)) for _, _, a, b in chain([first], group) if a is not None)
        for k, (a, b) in enumerate(each_chunk(own, int(first[1]), target_ms, overlap_ms)):
            yield key[0], k, a, b

    return live.over_groups(rows, ["job_id"], [F.col("start_ms"), F.col("end_ms")], each, "job_id bigint, chunk_ix int, start_ms bigint, end_ms bigint")
