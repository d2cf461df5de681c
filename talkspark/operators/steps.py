"""Runs of lines that close by their length, without one task for a recording.

A run is open from its first line's start; it closes at the first line that ends `reach` after that or later. What comes next depends on
where it closed, so runs are a fold over a recording; but all that a range of lines needs to know of those before it is the start of
the run that is open, and all that those after it need is which run it leaves open. Lines are sorted into ranges; each
tells, for any run that may reach into it, how often it cuts and what it leaves: only lines in the first `reach` of the range
can close such a run, so that is a short list. One row for each range goes through a fold over recordings, and each
range is then numbered from its own entry.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.operators.live import over_groups
from talkspark.operators.places import in_ranges, stored


class Range:
    """The lines of one range. after: the line that closes a run is its last one (step batches), else the next one's first (pieces).

    A start that is null never lets a run close, an end that is null closes none.
    """

    def __init__(self, lines: Iterable[tuple[int | None, int | None]], reach: int, after: bool):
        both = list(lines)
        self.starts = [math.inf if a is None else a for a, _ in both]
        self.ends = [-math.inf if b is None else b for _, b in both]
        self.reach, self.after = reach, after
        n = len(both)
        #: of a run opened at each line: cuts until the end of the range, start of the run that is open then (None: none is)
        self.left: list[tuple[int, float | None]] = [(0, None)] * (n + 1)
        later: list[tuple[float, int]] = []  # (-end, line) of lines that end after all between, the nearest last
        for j in range(n - 1, -1, -1):
            if not after:
                self.left[j] = self.opened(j, later)
            while later and -later[-1][0] <= self.ends[j]:
                later.pop()
            later.append((-self.ends[j], j))
            if after:
                self.left[j] = self.opened(j, later)

    def opened(self, j: int, later: list[tuple[float, int]]) -> tuple[int, float | None]:
        # ends grow towards the front of `later`: the last place whose end is far enough is the nearest line
        k = bisect_left(later, (-(self.starts[j] + self.reach), math.inf))
        return (0, self.starts[j]) if k == 0 else self.closed(later[k - 1][1])

    def closed(self, k: int) -> tuple[int, float | None]:
        """Cuts and what is left when a run closes at line k."""
        cuts, first = self.left[k + 1 if self.after else k]
        return cuts + 1, first

    def entries(self) -> list[tuple[float, int, float | None]]:
        """(latest start, cuts, left) of runs that are open before the range, by their start; later ones don't close in it."""
        out: list[tuple[float, int, float | None]] = []
        for k, end in enumerate(self.ends):
            latest = end - self.reach
            if not out or latest > out[-1][0]:
                out.append((latest, *self.closed(k)))
                if latest >= self.starts[0]:
                    break
        return out


def walk(lines: Iterable[tuple[int | None, int | None]], reach: int, after: bool, number: int = 0, first: float | None = None) -> Iterator[int]:
    """The run of each line, from what is open before."""
    for start, end in lines:
        far = -math.inf if end is None else end
        if not after and first is not None and far - first >= reach:
            number, first = number + 1, None
        first = (math.inf if start is None else start) if first is None else first
        yield number
        if after and far - first >= reach:
            number, first = number + 1, None


def runs(rows: DataFrame, keys: list[str], order: list[str], reach: int, name: str, after: bool = True, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """rows with the number of their run within the key, in order; start is the first of order."""
    by = [F.col(c).asc_nulls_last() for c in order]
    rows = rows.select(*keys, *(c for c in rows.columns if c not in keys and c != name))
    kept = in_ranges(rows, keys, by, "__range")
    n = len(keys)
    fields = [rows.schema[k] for k in keys]
    entry = T.ArrayType(T.StructType([T.StructField("latest", T.DoubleType()), T.StructField("cuts", T.LongType()), T.StructField("left", T.DoubleType())]))
    part = T.StructField("__range", T.IntegerType())

    def tell(key: tuple, lines: Iterator[tuple]) -> Iterator[tuple]:
        r = Range(((x[n + 1], x[n + 2]) for x in lines), reach, after)
        yield *key, *r.left[0], r.entries()

    slim = kept.select(*keys, "__range", F.col(start).alias("__start"), F.col(end).alias("__end"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(order)))
    told = over_groups(slim, [*keys, "__range"], [F.col(f"__{i}").asc_nulls_last() for i in range(len(order))], tell, T.StructType([*fields, part, T.StructField("cuts", T.LongType()), T.StructField("left", T.DoubleType()), T.StructField("entries", entry)]))

    def enter(key: tuple, ranges: Iterator[tuple]) -> Iterator[tuple]:
        number, first = 0, None
        for r in ranges:
            place, cuts, left, entries = r[n:]
            yield *key, place, number, first
            if first is None:
                number, first = number + cuts, left
            else:
                e = next((x for x in entries if first <= x["latest"]), None)
                if e is not None:
                    number, first = number + e["cuts"], e["left"]

    entered = stored(over_groups(told, keys, [F.col("__range")], enter, T.StructType([*fields, part, T.StructField("__number", T.LongType()), T.StructField("__first", T.DoubleType())])), "entries")
    whole = kept.alias("k").join(entered.alias("e"), [F.col(f"k.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys] + [F.col("k.__range") == F.col("e.__range")])
    whole = whole.select(*(F.col(f"k.{c}") for c in rows.columns), F.col("k.__range").alias("__range"), F.col("e.__number").alias("__number"), F.col("e.__first").alias("__first"))
    at = {c: i for i, c in enumerate([*keys, "__range", *(c for c in rows.columns if c not in keys), "__number", "__first"])}

    def number(key: tuple, lines: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def given() -> Iterator[tuple]:
            for x in lines:
                held.append(x)
                yield x[at[start]], x[at[end]]

        head = next(lines, None)
        if head is None:
            return
        lines = chain([head], lines)
        for k in walk(given(), reach, after, head[at["__number"]], head[at["__first"]]):
            x = held.pop()
            yield *x[:n], *x[n + 1 : -2], k

    return over_groups(whole, [*keys, "__range"], by, number, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))
