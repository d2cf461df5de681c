"""Readable lines of segments: splitting at sentences and silences, removals, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions.scalars import display_name, rendered
from talkspark.operators.places import dealt

#: A silence splits at the 90th percentile of the last HISTORY gaps, LEAST_MS at least, once KNOWN gaps are there.
LEAST_MS, HISTORY, KNOWN, SHARE = 600, 20, 5, 0.9
SENTENCE_END = r"[.!?]$"


def long_silence(gaps: Column) -> Column:
    """The silence that splits after sorted gaps: their 90th percentile, interpolated, LEAST_MS at least."""
    at = SHARE * (F.size(gaps) - 1)
    low = F.floor(at).cast("int")
    below, above = F.get(gaps, low), F.get(gaps, F.least(low + 1, F.size(gaps) - 1))
    return F.greatest(F.lit(float(LEAST_MS)), below + (above - below) * (at - low))


def newest(gaps: Column) -> Column:
    return F.when(F.size(gaps) <= HISTORY, gaps).otherwise(F.slice(gaps, -HISTORY, HISTORY))


def split_words(words: DataFrame, before: DataFrame | None = None, keep: bool = False, parts: int | None = None) -> DataFrame:
    """words of segments (job_id, seg_no, speaker, pos, ...) with line_no within the job.

    seg_no orders the segments of a job. A line begins with each segment, after a word that ends a sentence, and
    at a silence that is long for the speaker's run of segments: gaps within segments only, those before the
    current one, forgotten when the speaker changes. before (job_id, run_speaker, gaps, n_lines) tells of the
    words until now: the last one's speaker, history_gaps() and the number of lines; keep leaves the columns that it needs.
    parts: as of dealt().
    """
    job = Window.partitionBy("job_id").orderBy("seg_no", "pos")
    w = dealt(words, parts, "job_id").withColumns({"before": F.lag("speaker").over(job), "seg_before": F.lag("seg_no").over(job), "end_before": F.lag("end_ms").over(job), "word_before": F.lag("word").over(job)})
    change = F.coalesce(F.col("speaker") != F.col("before"), F.lit(True)).cast("int")
    opens = F.coalesce(F.col("seg_no") != F.col("seg_before"), F.lit(True))
    w = w.withColumns({"run": F.sum(change).over(job), "opens": opens, "gap": F.when(~opens, F.greatest(F.lit(0), F.col("start_ms") - F.col("end_before")))})
    # the last gaps by their number in the run: even places, words that open a segment have none and stand between
    own = Window.partitionBy("job_id", "run")
    w = w.withColumn("place", 2 * F.count("gap").over(own.orderBy("seg_no", "pos")) + F.col("opens").cast("int"))
    w = w.withColumn("past", F.collect_list("gap").over(own.orderBy("place").rangeBetween(-2 * HISTORY, -1)))
    first_line = F.lit(0)
    if before is not None:
        w = w.join(before.select("job_id", "run_speaker", "gaps", "n_lines"), "job_id", "left")
        goes_on = (F.col("run") == 1) & (F.col("speaker") == F.col("run_speaker"))
        w = w.withColumn("past", F.when(goes_on, newest(F.concat("gaps", "past"))).otherwise(F.col("past")))
        first_line = F.coalesce("n_lines", F.lit(0))
    # a gap under LEAST_MS is never long, so that the others' histories only are sorted
    w = w.withColumn("sorted", F.when(F.col("gap") >= LEAST_MS, F.sort_array("past")))
    silent = (F.size("past") >= KNOWN) & (F.col("gap") >= long_silence(F.col("sorted")))
    w = w.withColumn("breaks", F.col("opens") | F.col("word_before").rlike(SENTENCE_END) | F.coalesce(silent, F.lit(False)))
    w = w.withColumn("line_no", F.sum(F.col("breaks").cast("int")).over(job) - 1 + first_line)
    return w if keep else w.select(*words.columns, "line_no")


def history_gaps(split: DataFrame) -> Column:
    """Of words split with keep, in an aggregate: the newest gaps of the run after the last word."""
    own = F.when(split["gap"].isNotNull(), F.array(split["gap"])).otherwise(F.array().cast("array<bigint>"))
    return F.max_by(newest(F.concat(split["past"], own)), F.struct("seg_no", "pos"))


def lines(words: DataFrame, *more: Column) -> DataFrame:
    """(job_id, line_no, speaker, label, start_ms, end_ms, text) from split words, and more aggregates; label may be null."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "pos", "word"))), lambda x: x["word"]), " ")
    return words.groupBy("job_id", "line_no").agg(
        F.first("speaker").alias("speaker"), F.first("label").alias("label"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"), *more
    )


def sentence_lines(segments: DataFrame) -> DataFrame:
    """Lines of segments that have text but no word times: a sentence gets its share of the span by characters."""
    key = ["job_id", "seg_no"]
    s = segments.select(*key, "speaker", "start_ms", "end_ms", F.posexplode(F.split(F.trim("text"), r"(?<=[.!?])\s+")).alias("part", "text")).where("text <> ''")
    order = Window.partitionBy(*key).orderBy("part")
    upto, whole = F.sum(F.length("text")).over(order), F.sum(F.length("text")).over(Window.partitionBy(*key))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda chars: F.col("start_ms") + F.round(span * chars / whole)
    return s.select(*key, "part", "speaker", at(upto - F.length("text")).cast("long").alias("line_start"), at(upto).cast("long").alias("line_end"), "text")


def without_removed(made: DataFrame, speakers: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines less those of removed speakers (job_id, speaker) and removed lines (job_id, speaker, start_ms)."""
    return made.join(speakers, ["job_id", "speaker"], "left_anti").join(keys, ["job_id", "speaker", "start_ms"], "left_anti")


def flagged(made: DataFrame, speakers: DataFrame, keys: DataFrame) -> DataFrame:
    """All lines, with removed: whether the speaker or the line is."""
    s = speakers.distinct().withColumn("s_gone", F.lit(True))
    k = keys.distinct().withColumn("k_gone", F.lit(True))
    out = made.join(s, ["job_id", "speaker"], "left").join(k, ["job_id", "speaker", "start_ms"], "left")
    return out.withColumn("removed", F.coalesce("s_gone", F.lit(False)) | F.coalesce("k_gone", F.lit(False))).drop("s_gone", "k_gone")


def rendered_lines(made: DataFrame) -> DataFrame:
    """(job_id, line_no, line): [hh:mm:ss] Name: text."""
    return made.select("job_id", "line_no", rendered(F.col("start_ms"), display_name(F.col("label"), F.col("speaker")), F.col("text")).alias("line"))
