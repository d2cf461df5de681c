"""Operator 4, chat formatting: transcripts are parsed by a hidden Markov model before turns are rendered.

Each line of a transcript is an observation: the speaker marker that it carries (a role name given with its
record or written before a colon at its start, under any of the usual names, or none), whether it opens a
record, its length class, and whether it asks. Hidden states are the canonical roles. Start, transition (into
lines that open a record and lines that go on) and emission probabilities are counted over all records with a known role and smoothed. Viterbi's best path gives
every line a role, also where markers are missing, unknown or not believed; runs of one role within a record
are canonical turns, rendered with the role's header and footer.

A conversation may be of any length: lines are cut into blocks by place; each block is reduced to the best
score from each state before it to each last state (a small matrix), blocks are combined level by level in the (max, +)
algebra, the best ends are handed back down, and each block fills its own path. The result is the same as
that of one pass, and no task holds more than a block of lines or of summaries.

Defined results: a null or empty text has one empty line; null and unknown roles are no marker; a record with a
null conv_id is a conversation of its own; null turns stand first; records with the same conv_id, turn, role
and text are one record, with `copies` their number; records of one turn are ordered by the MD5 of their text;
an empty table gives no rows; input columns besides these four take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.llm.common import cut

ROLES = ("system", "user", "assistant")
#: Names that speakers go by, for each role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context", "sys"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a", "agent", "chatbot"),
}
HEAD, FOOT = "<|im_start|>", "<|im_end|>"
#: Bits of a place that blocks of each level leave out (256 places make a turn); added to counts; share of markers
#: taken to be missing, a tenth of it wrong.
LEVELS, SMOOTH, MISSING = (4, 16, 30, 46, 62), 0.5, 0.2
MARKERS, KINDS = len(ROLES) + 1, 12


def role_of(name: Column) -> Column:
    """Number of the role that a name stands for, null if none."""
    plain = F.lower(F.trim(name))
    out = F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        out = F.when(plain.isin(*NAMES[r]), F.lit(i)).otherwise(out)
    return out


def transcript_lines(records: DataFrame) -> DataFrame:
    """(conv, place, line_no, role, marker, kind, line, copies): the lines of all records, in blocks by place."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(text.cast("binary"))
    one = records.select("conv_id", "turn", "role", text.alias("text"), key.alias("key"))
    one = one.groupBy("conv_id", "turn", "role", "text", "key").agg(F.count("*").alias("copies"))
    conv = F.when(F.col("conv_id").isNull(), F.concat(F.lit("-"), F.col("key"), F.coalesce(F.col("turn").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    # negative turns stand before others; null before all
    bound = (1 << 40) - 1  # turns beyond it stand at the ends
    turn = F.coalesce(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("turn").cast("long"))) + (1 << 40), F.lit(0).cast("long"))
    place = turn * 256 + F.conv(F.substring("key", 1, 2), 16, 10).cast("long")
    one = one.select("conv_id", "turn", conv.alias("conv"), place.alias("place"), "key", F.coalesce("role", F.lit("")).alias("given"), "copies", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    written = F.regexp_extract("raw", r"^\s*[\[(<*#]*\s*([A-Za-z]{1,12})\s*[\])>*]*\s*:\s*", 1)
    inline = F.when(written != "", role_of(written))
    given = F.when(F.col("line_no") == 0, role_of(F.col("given")))
    line = F.when(inline.isNotNull(), F.regexp_replace("raw", r"^\s*[\[(<*#]*\s*[A-Za-z]{1,12}\s*[\])>*]*\s*:\s*", "")).otherwise(F.col("raw"))
    size = F.when(F.length(line) < 40, 0).when(F.length(line) < 200, 1).otherwise(2)
    asks = F.when(F.rtrim(line).endswith("?"), 1).otherwise(0)
    opens = F.when((F.col("line_no") == 0) | inline.isNotNull(), 1).otherwise(0)
    return one.select(
        "conv_id", "turn", "conv", "place", "key", "given", "line_no", role_of(F.col("given")).alias("known"),
        F.coalesce(inline, given, F.lit(len(ROLES))).alias("marker"), (size * 4 + asks * 2 + opens).alias("kind"), line.alias("line"), "raw", inline.alias("written"), "copies",
    )


class Model:
    """Logarithms: start [S], move [2, S, S] (into a line that goes on, into one that opens), marker [S, MARKERS]
    and kind [S, KINDS]. The state before a conversation is number S."""

    def __init__(self, lines: DataFrame):
        s = len(ROLES)
        known = lines.where("known is not null")
        seen = np.full((s, MARKERS, KINDS), 0.0)
        # counts over roles, markers and kinds: a fixed number of rows
        for r in known.groupBy("known", "marker", "kind").count().collect():
            seen[r.known, r.marker, r.kind] += r["count"]
        # within a record the role stays; to the next turn it moves (equi-join on conversation and turn)
        first = known.where("line_no = 0").select("conv_id", "turn", "known")
        after = first.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("known").alias("next"))
        move = np.zeros((2, s, s))
        for r in first.join(after, ["conv_id", "turn"]).groupBy("known", "next").count().collect():
            move[1, r.known, r.next] += r["count"]
        move[0] += np.diag(seen[:, :, [k for k in range(KINDS) if k % 2 == 0]].sum(axis=(1, 2)))
        start = np.zeros(s)
        for r in first.where("turn = 0").groupBy("known").count().collect():
            start[r.known] += r["count"]
        marker = seen.sum(axis=2)
        marker[:, -1] += MISSING * marker[:, :-1].sum(axis=1)
        marker[:, :-1] += MISSING * marker[:, :-1].sum(axis=1, keepdims=True) / s / 10
        norm = lambda x: np.log((x + SMOOTH) / (x + SMOOTH).sum(axis=-1, keepdims=True))
        self.start, self.marker, self.kind = norm(start), norm(marker), norm(seen.sum(axis=1))
        self.move = np.log((move + SMOOTH / 100) / (move + SMOOTH / 100).sum(axis=-1, keepdims=True))

    def line(self, marker: int, kind: int) -> np.ndarray:
        """[S + 1, S]: score of each state of a line, from each state before it."""
        into = np.vstack([self.move[kind % 2], self.start])
        return into + self.marker[:, marker] + self.kind[:, kind]

    @staticmethod
    def joined(parts: list[np.ndarray]) -> np.ndarray:
        """Best score from each state before the first part to each last state of the last."""
        out = parts[0]
        for p in parts[1:]:
            out = (out[:, :, None] + p[None, :-1]).max(axis=1)
        return out

    @staticmethod
    def ends(parts: list[np.ndarray], before: int, last: int) -> list[tuple[int, int]]:
        """The state before and the last state of each part, on the best path from `before` to `last`."""
        score, came = parts[0][before], []
        for p in parts[1:]:
            total = score[:, None] + p[:-1]
            came.append(total.argmax(axis=0))
            score = total.max(axis=0)
        states = [last]
        for c in reversed(came):
            states.append(int(c[states[-1]]))
        states = [before, *reversed(states)]
        return list(zip(states[:-1], states[1:], strict=True))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys in sorted batches, across batch borders."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, run in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield list(run)


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def line_roles(lines: DataFrame, model: Model) -> DataFrame:
    """lines with state, the number of the role on the best path of the conversation."""
    at = lambda level: F.shiftright("place", LEVELS[level])
    matrix = "conv string, place bigint, m array<double>"
    shape = (len(ROLES) + 1, len(ROLES))
    m_schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("m", pa.list_(pa.float64()))])
    e_schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("before", pa.int64()), ("last", pa.int64())])

    def dealt(df: DataFrame, *order: str) -> DataFrame:
        return df.repartition("conv", "block").sortWithinPartitions("conv", "block", *order)

    def reduce_lines(batches):
        def out():
            for run in grouped(batches, ["conv", "block"]):
                yield {"conv": run[0]["conv"], "place": run[0]["place"], "m": model.joined([model.line(r["marker"], r["kind"]) for r in run]).ravel().tolist()}
        return batched(out(), m_schema)

    def reduce_blocks(batches):
        def out():
            for run in grouped(batches, ["conv", "block"]):
                yield {"conv": run[0]["conv"], "place": run[0]["place"], "m": model.joined([np.array(r["m"]).reshape(shape) for r in run]).ravel().tolist()}
        return batched(out(), m_schema)

    def top(batches):
        def out():
            for b in batches:
                for r in b.to_pylist():
                    m = np.array(r["m"]).reshape(shape)
                    yield {"conv": r["conv"], "place": r["place"], "before": len(ROLES), "last": int(m[-1].argmax())}
        return batched(out(), e_schema)

    def hand_down(batches):
        def out():
            for run in grouped(batches, ["conv", "block"]):
                parts = [np.array(r["m"]).reshape(shape) for r in run]
                for r, (a, b) in zip(run, model.ends(parts, run[0]["before"], run[0]["last"]), strict=True):
                    yield {"conv": r["conv"], "place": r["place"], "before": a, "last": b}
        return batched(out(), e_schema)

    # places stand for blocks: the first line's place, cut to the block of the level
    lines = lines.withColumn("block", at(0))
    order = ["place", "key", "given", "line_no"]
    slim = dealt(lines.select("conv", "block", *order, "marker", "kind"), *order)
    levels = [cut(slim.mapInArrow(reduce_lines, matrix))]
    reach = lines.agg(F.min("place").alias("low"), F.max("place").alias("high")).first()
    top_level = next(k for k in range(len(LEVELS)) if reach.low is None or reach.low >> LEVELS[k] == reach.high >> LEVELS[k])
    for k in range(1, top_level + 1):
        levels.append(cut(dealt(levels[-1].withColumn("block", at(k)), "place").mapInArrow(reduce_blocks, matrix)))
    ends = cut(levels[-1].mapInArrow(top, "conv string, place bigint, before bigint, last bigint"))
    for k in range(top_level, 0, -1):
        above = ends.select("conv", at(k).alias("block"), "before", "last")
        below = levels[k - 1].withColumn("block", at(k)).join(above, ["conv", "block"])
        ends = cut(dealt(below, "place").mapInArrow(hand_down, "conv string, place bigint, before bigint, last bigint"))
    with_ends = lines.join(ends.select("conv", at(0).alias("block"), "before", "last"), ["conv", "block"])
    fields = with_ends.drop("before", "last", "block")

    def fill(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        def out():
            for run in grouped(batches, ["conv", "block"]):
                each = [model.line(r["marker"], r["kind"]) for r in run]
                for r, (_, s) in zip(run, model.ends(each, run[0]["before"], run[0]["last"]), strict=True):
                    yield {k: v for k, v in r.items() if k not in ("before", "last", "block")} | {"state": s}
        return batched(out(), to_arrow_schema(final))

    from pyspark.sql import types as T

    final = T.StructType([*fields.schema.fields, T.StructField("state", T.IntegerType())])
    return dealt(with_ends, *order).mapInArrow(fill, final)


def chat_turns(records: DataFrame) -> DataFrame:
    """One row for each run of one role within a record: a record whose lines change role gives several parts."""
    lines = cut(transcript_lines(records))
    done = cut(line_roles(lines, Model(lines)))
    record = Window.partitionBy("conv", "place", "key", "given").orderBy("line_no")
    done = done.withColumn("new", F.coalesce((F.col("state") != F.lag("state").over(record)).cast("int"), F.lit(0)))
    done = done.withColumn("part", F.sum("new").over(record))
    # a written marker goes only where the path agrees that it is one: no other character of a text is lost
    done = done.withColumn("line", F.when(F.col("written") == F.col("state"), F.col("line")).otherwise(F.col("raw")))
    parts = done.groupBy("conv", "conv_id", "turn", "place", "key", "given", "part").agg(
        F.first("state").alias("state"), F.count("*").alias("n_lines"), F.first("copies").alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    return parts


def escaped(text: Column) -> Column:
    """text with a backslash more in each of its own control tokens, so that no text opens or ends a turn."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<\\$1|$2|>")


def rendered(parts: DataFrame) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("state") + 1)
    return parts.select(
        "conv_id", "turn", F.col("part").cast("int").alias("part"), role.alias("role"), "n_lines", "copies",
        F.concat(F.lit(HEAD), role, F.lit("\n"), escaped(F.trim("text")), F.lit(FOOT + "\n")).alias("rendered"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(chat_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
