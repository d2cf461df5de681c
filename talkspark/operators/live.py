"""Live meetings on a finished log: release, windows, marks, batches, sections, items, context.

The order-dependent folds are plain functions over ordered rows; the streaming module calls the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions.scalars import blank_to_null, overlap_ms
from talkspark.operators.intervals import BUCKET_MS
from talkspark.operators.places import numbered_within

#: Rows in a batch that a fold gives back.
BATCH = 10_000
STEP_MS, REACH_BEFORE, REACH_AFTER = 30_000, 4_000, 500


def released(lines: DataFrame, tracks: int = 2) -> DataFrame:
    """lines (recording, track, seq, start_ms, end_ms, covered_ms) with released_at: the first seq at which all tracks are
    covered past the line's start, null while one isn't."""
    up_to = Window.partitionBy("recording", "track").orderBy("seq")
    cover = lines.withColumn("covered", F.max("covered_ms").over(up_to))
    # the first event of each track that covers a start: as-of by value, in one ordered pass over both kinds of rows
    marks = cover.select("recording", "track", "seq", "covered").withColumn("before", F.coalesce(F.lag("covered").over(up_to), F.lit(-1))).where("covered > before")
    start = lines.select("recording", F.col("seq").alias("line_seq"), "start_ms")
    both = marks.select("recording", F.col("covered").alias("at"), F.lit(1).alias("kind"), "track", "seq", F.lit(None).cast("long").alias("line_seq")).unionByName(
        start.select("recording", F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("track"), F.lit(None).cast("long").alias("seq"), "line_seq")
    )
    later = Window.partitionBy("recording").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    first = lambda t: F.min(F.when(F.col("track") == t, F.col("seq"))).over(later)
    both = both.withColumns({"mic_at": first("mic"), "system_at": first("system")})
    when = F.when(F.col("mic_at").isNotNull() & F.col("system_at").isNotNull(), F.greatest("mic_at", "system_at", "line_seq"))
    done = both.where("kind = 0").select("recording", F.col("line_seq").alias("seq"), when.alias("released_at"))
    return lines.join(done, ["recording", "seq"])


def release_order(lines: DataFrame) -> DataFrame:
    """Released lines with their place in the recording: as they come out, those of one release by start and end, whatever the track."""
    order = [F.col(c) for c in ("released_at", "start_ms", "end_ms", "track", "seq")]
    return numbered_within(lines.where("released_at is not null"), ["recording"], order, "place")


def rolling_window(pieces: DataFrame, span_ms: int = 60_000, gap_ms: int = 0) -> DataFrame:
    """pieces (recording, track, start_ms, end_ms) with stretch (a gap in time starts a new one) and the pieces and time of
    the last span_ms of it."""
    order = Window.partitionBy("recording", "track").orderBy("start_ms", "seq")
    gap = F.col("start_ms") - F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = pieces.withColumn("stretch", F.sum(F.coalesce((gap > gap_ms).cast("int"), F.lit(0))).over(order))
    last = Window.partitionBy("recording", "track", "stretch").orderBy("start_ms").rangeBetween(-span_ms, 0)
    return p.withColumns({"n_window": F.count("*").over(last), "window_start": F.min("start_ms").over(last)})


def marked_voices(marks: DataFrame, turns: DataFrame) -> DataFrame:
    """marks (recording, mark, at_ms) with who spoke most from 4 s before to 0.5 s after; null if nobody did.

    A range join in buckets of BUCKET_MS, like spans and turns.
    """
    m = marks.withColumns({"start_ms": F.col("at_ms") - REACH_BEFORE, "end_ms": F.col("at_ms") + REACH_AFTER})
    b = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / BUCKET_MS), F.greatest(F.floor(F.col(s) / BUCKET_MS), F.floor((F.col(e) - 1) / BUCKET_MS))))
    left = m.withColumn("bucket", b("start_ms", "end_ms"))
    right = turns.select("recording", "speaker", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end")).withColumn("bucket", b("t_start", "t_end"))
    pairs = left.join(right, ["recording", "bucket"]).withColumn("o", overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("t_start"), F.col("t_end"))).where("o > 0")
    best = pairs.groupBy("recording", "mark", "speaker").agg(F.max("o").alias("o")).groupBy("recording", "mark").agg(F.min(F.struct((-F.col("o")).alias("o"), "speaker")).alias("b"))
    return marks.join(best.select("recording", "mark", "b.speaker"), ["recording", "mark"], "left")


def last_known(rows: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """rows with the value filled from the latest earlier row of the keys that has one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def fresh_talk(turns: DataFrame) -> DataFrame:
    """Talk and fresh time of each window's speakers: turns (recording, window_ix, speaker, start_ms, end_ms, fresh_from)."""
    fresh = F.greatest(F.lit(0), F.col("end_ms") - F.greatest("start_ms", "fresh_from"))
    return turns.groupBy("recording", "window_ix", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("talk_ms"), F.sum(fresh).alias("fresh_ms"))


def numbered_events(events: DataFrame) -> DataFrame:
    return numbered_within(events, ["session"], [F.col("time"), F.col("event_id")], "seq").withColumn("seq", F.col("seq") - 1)


def context_tail(blocks: DataFrame, budget: int) -> DataFrame:
    """The newest blocks (session, seq, text) of each session while their lengths, plus one each, fit the budget."""
    newest = Window.partitionBy("session").orderBy(F.desc("seq"))
    used = F.sum(F.length("text") + 1).over(newest)
    b = blocks.withColumns({"used": used, "n": F.count("*").over(Window.partitionBy("session"))}).where(F.col("used") <= budget)
    return b.withColumn("cut", F.count("*").over(Window.partitionBy("session")) < F.col("n")).drop("n", "used")


def timeline(lines: DataFrame, sections: DataFrame, comments: DataFrame) -> DataFrame:
    """One conversation in order: section headers at their start, comments after the line that they follow."""
    part = lambda df, rank: df.select("recording", F.col("at_ms").alias("at_ms"), F.lit(rank).alias("rank"), "text")
    rows = part(sections, 0).unionByName(part(lines, 1)).unionByName(part(comments, 2))
    return numbered_within(rows, ["recording"], [F.col(c) for c in ("at_ms", "rank", "text")], "place")


def gates(rows: DataFrame, paused: Column) -> DataFrame:
    """Whether a comment and whether items are asked for: p (comment), p_decision, p_todo in thousandths."""
    return rows.withColumns({"comment": (F.col("p_milli") >= 500) & ~paused, "items": F.greatest("p_decision", "p_todo") >= 500})


def already_said(batches: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of a section that a batch may know: made at or before its end."""
    c = comments.select("recording", "section", F.col("at_ms").alias("c_at"), "comment_id")
    return batches.join(c, ["recording", "section"]).where(F.col("c_at") <= F.col("until_ms")).groupBy("recording", "section", "batch").agg(F.count("*").alias("n_known"), F.max("comment_id").alias("latest"))


def due_times(lines: DataFrame, speed: float) -> DataFrame:
    first = F.min("start_ms").over(Window.partitionBy("recording"))
    return lines.withColumn("due_ms", F.round((F.col("end_ms") - first) / speed).cast("long"))


# ---- folds over ordered rows -------------------------------------------------------------------------------------


def step_batches(rows: Iterable[tuple[int, int]], step: int = STEP_MS) -> list[int]:
    """Batch number of each (start, end): a batch closes when its last end is `step` after its first start."""
    return list(each_step_batch(rows, step))


def each_step_batch(rows: Iterable[tuple[int, int]], step: int = STEP_MS) -> Iterator[int]:
    """step_batches, one row at a time."""
    number, first = 0, None
    for start, end in rows:
        first = start if first is None else first
        yield number
        if end - first >= step:
            number, first = number + 1, None


def each_piece(rows: Iterable[tuple[int, int]], longest: int = 120_000) -> Iterator[int]:
    """Piece number of each (start, end) of a backlog, one row at a time: a row that would make the piece longer than `longest` opens one."""
    number, first = 0, None
    for start, end in rows:
        if first is None:
            first = start
        elif end - first > longest:
            number, first = number + 1, start
        yield number


@dataclass
class OpenSection:
    """The section of a meeting that is open: its number, its first line's start, its last line's end. None before the first line."""

    number: int = 0
    opened: int | None = None
    last_end: int = 0


def each_batch_section(batches: Iterable[tuple[int, int, int, int]], longest: int = 900_000, shortest: int = 60_000, sure: int = 600, at: OpenSection | None = None) -> Iterator[tuple[int, int]]:
    """Section numbers (head, tail) of each batch (first start, last end, start of the line that the model chose, p_topic): lines before
    the chosen one are in head, the others in tail. A section that has lasted `longest` before a batch is closed, and the batch
    opens the next one; one that has lasted `shortest` is closed at the chosen line if the topic surely changes. `at` goes on from
    earlier batches and is changed in place."""
    at = at or OpenSection()
    for first, last, chosen, p in batches:
        head = at.number
        if at.opened is None:
            at.opened = first
        elif at.last_end - at.opened >= longest:
            head, at.number, at.opened = at.number + 1, at.number + 1, first
        elif at.last_end - at.opened >= shortest and p >= sure:
            at.number, at.opened = at.number + 1, chosen
        at.last_end = last
        yield head, at.number


SECTION = "recording bigint, number bigint, opened bigint, last_end bigint"


def sections(lines: DataFrame, answers: DataFrame, longest: int = 900_000, shortest: int = 60_000, sure: int = 600, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """lines (recording, batch, start_ms, end_ms, ...) with section, and the sections that are open after them (SECTION).

    answers: what a model says of each batch, (recording, batch, p_milli, first_new): whether the topic changes and the place of
    the first line on the new one. Only a row for each batch goes through the fold over a recording. before: open sections of
    earlier batches.
    """
    key = ["recording", "batch"]
    own = Window.partitionBy(*key)
    order = ("start_ms", "end_ms", *(c for c in lines.columns if c not in (*key, "start_ms", "end_ms")))
    placed = lines.withColumns({"__place": F.row_number().over(own.orderBy(*order)) - 1, "__n": F.count("*").over(own)})
    placed = placed.join(answers.select(*key, F.col("p_milli").alias("__p"), F.col("first_new").alias("__new")), key, "left")
    placed = placed.withColumn("__cut", F.least(F.coalesce("__new", F.lit(0)), F.col("__n") - 1))
    batches = placed.groupBy(*key).agg(
        F.min_by("start_ms", "__place").alias("first"), F.max_by("end_ms", "__place").alias("last"), F.max(F.when(F.col("__place") == F.col("__cut"), F.col("start_ms"))).alias("chosen"),
        F.coalesce(F.max("__p"), F.lit(0)).alias("p"), F.max("__cut").alias("cut"),
    )
    if before is not None:  # what is open comes as a row before the first batch
        batches = batches.unionByName(before.select("recording", F.lit(-1).cast("bigint").alias("batch"), F.col("opened").alias("first"), F.col("last_end").alias("last"), F.col("number").alias("chosen"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("cut")))

    def each(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        at = OpenSection()
        for _, batch, first, last, chosen, p, cut in rows:
            if batch < 0:
                at = OpenSection(chosen, first, last)
                head, tail = at.number, at.number
            else:
                head, tail = next(each_batch_section([(first, last, chosen, p)], longest, shortest, sure, at))
            yield *key, batch, head, tail, cut, at.number, at.opened, at.last_end

    batches = batches.select(*key, "first", "last", "chosen", F.col("p").cast("bigint").alias("p"), F.col("cut").cast("bigint").alias("cut"))
    numbers = over_groups(batches, ["recording"], [F.col("batch")], each, "recording bigint, batch bigint, head bigint, tail bigint, cut bigint, number bigint, opened bigint, last_end bigint")
    out = placed.join(numbers.select(*key, F.col("head").alias("__head"), F.col("tail").alias("__tail"), F.col("cut").alias("__at")), key)
    out = out.withColumn("section", F.when(F.col("__place") < F.col("__at"), F.col("__head")).otherwise(F.col("__tail")))
    after = numbers.groupBy("recording").agg(F.max_by(F.struct("number", "opened", "last_end"), "batch").alias("at")).select("recording", "at.*")
    return out.select(*lines.columns, "section"), after


def place_voices(windows: Iterable[tuple[int, str, str, list[float], float, float]], same: float = 0.6, least_new: float = 10.0) -> list[tuple[int, str, str, str | None, float]]:
    """Meeting voices for the speakers of each window, in order: (window, track, speaker, voice, score).

    Of a window the speakers that talk most choose first: the nearest voice of their track that nobody of the
    window has, if the cosine is `same` or more; else, with little talk and voices there, the nearest (one that
    is free first); else a new one. A voice's print grows by the fresh seconds only.
    """
    return list(each_placed_voice(sorted(windows, key=lambda w: (w[0], w[1])), same, least_new))


@dataclass
class Voice:
    """A voice of a meeting: the sum of unit prints by the fresh seconds that each covers, and the last window that it is in."""

    track: str
    total: np.ndarray
    seconds: float = 0.0
    last: int = -1

    @property
    def print(self) -> np.ndarray:
        return self.total / max(float(np.linalg.norm(self.total)), 1e-300)


def each_placed_voice(ordered: Iterable[tuple[int, str, str, list[float], float, float]], same: float = 0.6, least_new: float = 10.0, voices: list[Voice] | None = None) -> Iterator[tuple[int, str, str, str | None, float]]:
    """place_voices of rows that come by window and track; holds one window and the voices, which may be given and grow in place."""
    voices = [] if voices is None else voices
    for _, group in groupby(ordered, key=lambda w: (w[0], w[1])):
        taken: set[int] = set()
        for ix, track, speaker, v, talk, fresh in sorted(group, key=lambda w: (-w[4], w[2])):
            x = np.array(v, dtype=float)
            size = np.linalg.norm(x)
            if not len(x) or size == 0:
                yield ix, track, speaker, None, 0.0
                continue
            x = x / size
            near = sorted(((float(x @ o.print), -i) for i, o in enumerate(voices) if o.track == track and len(o.total) == len(x)), reverse=True)
            free = [(s, -i) for s, i in near if -i not in taken]
            if free and free[0][0] >= same:
                score, k = free[0]
            elif near and talk < least_new:
                score, k = free[0] if free else (near[0][0], -near[0][1])
            else:
                voices.append(Voice(track, np.zeros(len(x))))
                score, k = 1.0, len(voices) - 1
            taken.add(k)
            own = voices[k]
            if fresh > 0 or not own.seconds:
                own.total = own.total + x * max(fresh, 1e-3)
                own.seconds += fresh
            own.last = int(ix)
            yield ix, track, speaker, f"S{k + 1}", score


def fold_items(updates: Iterable[dict]) -> dict[str, dict]:
    """Items after updates in order. The model's update with the id of an item changes it, any other with a kind and a text
    is a new item: D1, T1, ... of its kind, counting deleted ones; its blank fields keep what was, and items that the user
    edited or deleted are left alone. The user's edit sets the fields it has, a blank owner or due clears it, a blank
    text is refused; only the user deletes. at and section stay as first given."""
    items: dict[str, dict] = {}
    counts = {"decision": 0, "todo": 0}
    for u in updates:
        kind, key, user = u.get("kind"), u.get("id"), u.get("actor") == "user"
        old = items.get(key)
        if user:
            text = u.get("text")
            if old is None or old["deleted"] or u.get("op") != "delete" and text is not None and not text.strip():
                continue
            if u.get("op") == "delete":
                old["deleted"] = True
            else:
                old |= {k: u[k].strip() for k in ("text", "owner", "due") if u.get(k) is not None}
            old["locked"] = True
        elif u.get("op") == "delete":
            continue
        elif old is not None:
            if not old["locked"]:
                old |= {k: new for k in ("text", "owner", "due") if (new := (u.get(k) or "").strip())}
        elif kind in counts and (u.get("text") or "").strip():
            counts[kind] += 1
            items[f"{kind[0].upper()}{counts[kind]}"] = {
                "kind": kind, **{k: (u.get(k) or "").strip() for k in ("text", "owner", "due")}, "at": u.get("at"), "section": u.get("section"), "deleted": False, "locked": False,
            }
    return items


def grouped(batches: Iterable[pa.RecordBatch], n_keys: int, each: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """What each(key, rows) gives for the groups of sorted batches, rows as they come: no group is held."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for key, group in groupby(rows, key=lambda r: r[:n_keys]):
        for row in each(key, group):
            out.append(row)
            if len(out) >= size:
                yield batch()
    if out:
        yield batch()


def over_groups(rows: DataFrame, keys: list[str], order: list[Column], each: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """each(key, rows) for the groups of keys, rows in order as tuples, the keys first; each holds what state it needs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, n = to_arrow_schema(kind), len(keys)
    slim = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    return slim.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: grouped(batches, n, each, arrow), kind)


def folded(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], fold: Callable[[Iterable[tuple]], Iterator[int]], name: str) -> DataFrame:
    """rows with a column from a fold over the ordered rows of each key; the fold gives a number as it takes each row."""
    rows = rows.select(*keys, *(c for c in rows.columns if c not in keys and c != name))
    places = [rows.columns.index(c) for c in inputs]

    def each(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        own, given = tee(group)
        picked = (tuple(float("nan") if r[i] is None else r[i] for i in places) for r in given)
        for row, number in zip(own, fold(picked), strict=True):
            yield (*row, number)

    return over_groups(rows, keys, [F.col(c).asc_nulls_last() for c in order], each, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def valid_updates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item updates that can be used, trimmed, and those that can't: kind decision or todo, text not blank."""
    u = raw.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("kind", "text", "owner", "due")})
    fine = u["kind"].isin("decision", "todo") & (u["text"] != "")
    return u.where(fine), u.where(~fine)


def simple_items(updates: DataFrame) -> DataFrame:
    """Current items from a log without user edits: the last text that isn't blank, blank owner and due keep the old."""
    last = lambda c: F.max_by(c, F.when(blank_to_null(F.col(c)).isNotNull(), F.col("seq")))
    return updates.groupBy("session", "item").agg(last("text").alias("text"), last("owner").alias("owner"), F.min("at_ms").alias("at_ms"))


def visible_items(items: DataFrame) -> DataFrame:
    """Items (session, item, at_ms, deleted) that aren't deleted, with their place by time."""
    return numbered_within(items.where(~F.col("deleted")), ["session"], [F.col("at_ms"), F.col("item")], "place")


def items_markdown(items: DataFrame) -> DataFrame:
    """(session, markdown): decisions and to-dos by time, "None." where there are none."""
    extra = F.concat_ws(", ", F.when(F.col("owner") != "", F.concat(F.lit("owner: "), "owner")), F.when(F.col("due") != "", F.concat(F.lit("due: "), "due")))
    from talkspark.functions.scalars import clock

    line = F.concat(F.when(F.col("kind") == "todo", "- [ ] ").otherwise("- "), "text", F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""), F.lit(" ["), clock(F.col("at_ms")), F.lit("]"))
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at_ms", "item", line.alias("line"))))), lambda x: x["line"]), "\n")
    own = items.groupBy("session").agg(part("decision").alias("d"), part("todo").alias("t"))
    block = lambda c: F.when(F.col(c) == "", "None.").otherwise(F.col(c))
    return own.select("session", F.concat(F.lit("## Decisions\n\n"), block("d"), F.lit("\n\n## To-dos\n\n"), block("t"), F.lit("\n")).alias("markdown"))
