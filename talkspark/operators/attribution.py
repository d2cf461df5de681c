"""Who said which word: utterances, their speakers, islands of one speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions.scalars import UNKNOWN
from talkspark.operators.intervals import best_by, overlap_join
from talkspark.operators.places import dealt

PAUSE_MS = 150
CHUNK = ["job_id", "chunk_ix"]


def utterances(words: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """words with utt: a new one within a chunk where the gap to the word before is pause_ms or more."""
    order = Window.partitionBy(*CHUNK).orderBy("pos")
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    return words.withColumn("utt", F.sum(F.coalesce((gap >= pause_ms).cast("int"), F.lit(0))).over(order))


def spans_speakers(spans: DataFrame, turns: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """keys, speaker, seconds, first: time that each speaker shares with a group of spans.

    spans: keys, order of the spans of a group, start_ms, end_ms. Ties go to the speaker of the
    earliest (order, turn_ix) that overlaps.
    """
    t = turns.select("job_id", "speaker", "turn_ix", F.col("start_ms").alias("turn_start"), F.col("end_ms").alias("turn_end"))
    pairs = overlap_join(spans.select(*keys, *order, "start_ms", "end_ms"), t, ["job_id"], parts=parts)
    return pairs.groupBy(*keys, "speaker").agg(F.sum("overlap").alias("shared"), F.min(F.struct(*order, "turn_ix")).alias("first"))


def top_speaker(shares: DataFrame, keys: list[str]) -> DataFrame:
    """keys, speaker, shared of the speaker with the largest share; of equals the one that was first."""
    best = F.min(F.struct((-F.col("shared")).alias("less"), "first", "speaker")).alias("best")
    return shares.groupBy(*keys).agg(best).select(*keys, F.col("best.speaker").alias("speaker"), (-F.col("best.less")).alias("shared"))


def attributed(words: DataFrame, turns: DataFrame, pause_ms: int = PAUSE_MS, parts: int | None = None) -> DataFrame:
    """words with utt and speaker: that of its utterance, UNKNOWN where no turn overlaps. parts: as of dealt()."""
    said = utterances(words, pause_ms)
    keys = [*CHUNK, "utt"]
    best = top_speaker(spans_speakers(said, turns, keys, ["pos"], parts), keys).drop("shared")
    return dealt(said, parts, *keys).join(dealt(best, parts, *keys).hint("merge"), keys, "left").withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN)))


def dominant(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """spans (job_id, span_ix, start_ms, end_ms) with speaker and confidence: shared part of the span, 1 at most."""
    keys = ["job_id", "span_ix"]
    best = top_speaker(spans_speakers(spans, turns, keys, ["start_ms"]), keys)
    out = spans.join(best, keys, "left")
    # least skips nulls, so a span without a speaker needs the condition
    part = F.when(F.col("shared").isNotNull(), F.least(F.lit(1.0), F.col("shared") / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))))
    return out.withColumns({"speaker": F.coalesce("speaker", F.lit(UNKNOWN)), "speaker_confidence": F.coalesce(part, F.lit(0.0))}).drop("shared")


def text_of(words: Column, field: str = "word") -> Column:
    return F.array_join(F.transform(words, lambda w: w[field]), " ")


def segments(words: DataFrame, parts: int | None = None) -> DataFrame:
    """Islands of one speaker within a chunk: (job_id, chunk_ix, seg_ix, speaker, confidence, start, end, text, n_words)."""
    order = Window.partitionBy(*CHUNK).orderBy("pos")
    change = F.coalesce((F.col("speaker") != F.lag("speaker").over(order)).cast("int"), F.lit(0))
    marked = dealt(words, parts, *CHUNK).withColumn("change", change).withColumn("seg_ix", F.sum("change").over(order))
    word = F.struct("pos", "word", "start_ms", "end_ms")
    out = marked.groupBy(*CHUNK, "seg_ix").agg(
        F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"),
        F.sort_array(F.collect_list(word)).alias("words"),
    )
    sure = F.when(F.col("speaker") == UNKNOWN, 0.0).otherwise(1.0)
    return out.withColumns({"speaker_confidence": sure, "text": text_of(F.col("words"))})


def job_results(jobs: DataFrame, turns: DataFrame, segments: DataFrame) -> DataFrame:
    """jobs (job_id, transcribed) with turns, speakers and segments counted; those that were only diarized have no segments."""
    heard = turns.groupBy("job_id").agg(F.count("*").alias("n_turns"), F.countDistinct("speaker").alias("n_speakers"))
    said = segments.groupBy("job_id").agg(F.count("*").alias("n_segments"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_turns", "n_speakers", "n_segments")}
    return jobs.join(heard, "job_id", "left").join(said, "job_id", "left").withColumns(zero)


def merged(asr: DataFrame, words: DataFrame, turns: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments of chunks with words, then of chunks with text only; and warnings, one for each job and kind.

    asr: job_id, chunk_ix, text, start_ms, end_ms. Chunks without either give nothing.
    """
    by_word = segments(attributed(words, turns, parts=parts), parts)
    rest = asr.join(words.select(*CHUNK).distinct(), CHUNK, "left_anti").where(F.trim("text") != "")
    by_text = dominant(rest.withColumnRenamed("chunk_ix", "span_ix"), turns).withColumnRenamed("span_ix", "chunk_ix")
    columns = [*CHUNK, "seg_ix", "speaker", "speaker_confidence", "start_ms", "end_ms", "text"]
    by_text = by_text.withColumns({"seg_ix": F.lit(0).cast("bigint"), "text": F.trim("text")})
    out = by_word.select(*columns).unionByName(by_text.select(*columns))
    warnings = by_text.select("job_id").distinct().withColumn("warning", F.lit("no word times: one speaker for the whole segment"))
    return out, warnings


def without_overlap(chunks: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and words without what an earlier chunk has: from the second chunk on, words start at or after the
    latest end of the chunks before. A chunk that loses words gets its text and start from the rest; one that
    loses all goes; one that never had words stays."""
    before = Window.partitionBy("job_id").orderBy("chunk_ix").rowsBetween(Window.unboundedPreceding, -1)
    floors = chunks.withColumn("floor_ms", F.max("end_ms").over(before))
    kept = words.join(floors.select(*CHUNK, "floor_ms"), CHUNK).where(F.col("floor_ms").isNull() | (F.col("start_ms") >= F.col("floor_ms"))).drop("floor_ms")
    had = words.groupBy(*CHUNK).agg(F.count("*").alias("had"))
    has = kept.groupBy(*CHUNK).agg(
        F.count("*").alias("has"), F.min("start_ms").alias("first_ms"),
        text_of(F.array_sort(F.collect_list(F.struct("pos", "word")))).alias("new_text"),
    )
    out = chunks.join(had, CHUNK, "left").join(has, CHUNK, "left").where("had is null or has is not null")
    less = F.coalesce(F.col("has") < F.col("had"), F.lit(False))
    out = out.withColumns({"text": F.when(less, F.col("new_text")).otherwise(F.col("text")), "start_ms": F.when(less, F.col("first_ms")).otherwise(F.col("start_ms"))})
    return out.drop("had", "has", "first_ms", "new_text"), kept


def tokens_to_words(tokens: DataFrame) -> DataFrame:
    """Words of subword tokens (job_id, chunk_ix, tokens, starts, durations): a token with a leading space, or the
    first, opens a word; a word ends where its last token does."""
    some = F.coalesce("durations", F.array().cast("array<bigint>"))  # without durations words have no length
    t = tokens.select(*CHUNK, F.posexplode(F.arrays_zip("tokens", "starts", some.alias("durations"))).alias("ix", "t"))
    t = t.select(*CHUNK, "ix", "t.tokens", F.col("t.starts").alias("start_ms"), (F.col("t.starts") + F.coalesce("t.durations", F.lit(0))).alias("end_ms"))
    order = Window.partitionBy(*CHUNK).orderBy("ix")
    opens = (F.col("tokens").startswith(" ") | (F.col("ix") == 0)).cast("int")
    t = t.withColumn("pos", F.sum(opens).over(order) - 1)
    word = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "tokens"))), lambda x: x["tokens"]), ""))
    out = t.groupBy(*CHUNK, "pos").agg(word.alias("word"), F.min_by("start_ms", "ix").alias("start_ms"), F.max_by("end_ms", "ix").alias("end_ms"))
    return out.where("word <> ''")


def on_recording_clock(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words timed from their chunk's start, on the recording's clock, none ending after its chunk."""
    c = chunks.select(*CHUNK, F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"))
    out = words.join(c, CHUNK)
    return out.withColumns({"start_ms": F.col("start_ms") + F.col("c_start"), "end_ms": F.least(F.col("end_ms") + F.col("c_start"), "c_end")}).drop("c_start", "c_end")


__all__ = ["attributed", "best_by", "dominant", "job_results", "merged", "on_recording_clock", "segments", "tokens_to_words", "utterances", "without_overlap"]
