"""Live meetings, batch by batch: lines of pieces, their release, and the names that they get later.

Each step is made of the batch operators and of small states by recording or track that a Ledger carries; no recording is gathered in
one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions.scalars import UNKNOWN
from talkspark.operators import attribution, lines, live
from talkspark.operators.places import parts_for
from talkspark.operators.steps import runs
from talkspark.streaming.ledger import Ledger

TRACKS = ("mic", "system")
LINE = "recording bigint, track string, seq bigint, start_ms bigint, end_ms bigint"
COVERED = "recording bigint, track string, covered_ms bigint"


def release_step(batch: DataFrame, ledger: Ledger, tracks: tuple[str, ...] = TRACKS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A batch of (recording, track, seq, start_ms, end_ms, covered_ms): lines that are final now, those that wait for the other
    track, and how far each track is covered."""
    key = ["recording", "track"]
    own = batch.select(*key, "covered_ms")
    covered = ledger.state("covered", COVERED).unionByName(own).groupBy(*key).agg(F.max("covered_ms").alias("covered_ms"))
    level = covered.where(F.col("track").isin(*tracks)).groupBy("recording").agg(F.min("covered_ms").alias("level"), F.count("*").alias("n")).where(F.col("n") == len(tracks)).drop("n")
    waiting = ledger.state("pending", LINE).unionByName(batch.select(*key, "seq", "start_ms", "end_ms")).join(level, "recording", "left")
    final = F.coalesce(F.col("start_ms") < F.col("level"), F.lit(False))
    return {"lines": waiting.where(final).drop("level")}, {"pending": waiting.where(~final).drop("level"), "covered": covered}


def progress(ledger: Ledger) -> DataFrame:
    """How far each track of a recording is (recording, track, covered_ms, n_pending): what a restart goes on from."""
    waits = ledger.state("pending", LINE).groupBy("recording", "track").agg(F.count("*").alias("n_pending"))
    return ledger.state("covered", COVERED).join(waits, ["recording", "track"], "left").withColumn("n_pending", F.coalesce("n_pending", F.lit(0)))


# ---- pieces to lines ---------------------------------------------------------------------------------------------

TURN = "job_id bigint, turn_ix int, speaker string, start_ms bigint, end_ms bigint"
HEARD = "job_id bigint, last_speaker string, run_speaker string, gaps array<bigint>, n_lines bigint"
PIECE_LINE = "job_id bigint, line_no bigint, speaker string, start_ms bigint, end_ms bigint, text string"
TOP = "job_id bigint, chunk_ix bigint, top string"


def piece_speakers(words: DataFrame, turns: DataFrame, parts: int | None = None) -> DataFrame:
    """(job_id, chunk_ix, top): who talks most in each piece, null where nobody does. parts: as of dealt()."""
    key = attribution.CHUNK
    pieces = words.groupBy(*key).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    best = attribution.top_speaker(attribution.spans_speakers(pieces, turns, key, ["start_ms"], parts), key)
    return pieces.select(*key).join(best.select(*key, F.col("speaker").alias("top")), key, "left")


def with_fallback(segments: DataFrame, tops: DataFrame, last: DataFrame, track: str) -> DataFrame:
    """Segments of nobody go to who talked most in this piece or in the latest one before it that had anybody, else to the track.

    last: (job_id, last_speaker) before these pieces.
    """
    past = Window.partitionBy("job_id").orderBy("chunk_ix")
    known = tops.withColumn("known", F.last("top", ignorenulls=True).over(past)).join(last.select("job_id", "last_speaker"), "job_id", "left")
    known = known.select(*attribution.CHUNK, F.coalesce("known", "last_speaker", F.lit(track)).alias("fallback"))
    out = segments.join(known, attribution.CHUNK, "left")
    return out.withColumn("speaker", F.when(F.col("speaker") == UNKNOWN, F.col("fallback")).otherwise(F.col("speaker"))).drop("fallback")


def words_of_segments(segments: DataFrame) -> DataFrame:
    s = segments.withColumn("seg_no", F.col("chunk_ix") * 100_000 + F.col("seg_ix")).select("job_id", "seg_no", "speaker", F.explode("words").alias("w"))
    return s.select("job_id", "seg_no", "speaker", F.lit(None).cast("string").alias("label"), "w.pos", "w.word", "w.start_ms", "w.end_ms")


def pieces_step(batch: DataFrame, ledger: Ledger, track: str = TRACKS[0]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Pieces and the turns heard with them as lines, as one run over the whole recording would make them.

    batch: kind (word or turn), job_id, chunk_ix, pos, word, turn_ix, speaker, start_ms, end_ms. A turn comes with the first
    piece that it touches. Carried for each recording: turns that reach beyond what is covered, the last speaker for words
    of nobody, and the speaker, the silences and the number of lines so far, from which lines go on.
    """
    words = batch.where("kind = 'word'").select("job_id", "chunk_ix", "pos", "word", "start_ms", "end_ms")
    turns = ledger.state("turns", TURN).unionByName(batch.where("kind = 'turn'").select("job_id", "turn_ix", "speaker", "start_ms", "end_ms"))
    heard = ledger.state("heard", HEARD)
    parts = parts_for(batch.sparkSession, batch.count())
    tops = piece_speakers(words, turns, parts)

    def made(written) -> DataFrame:
        said = with_fallback(attribution.segments(attribution.attributed(words, turns, parts=parts), parts), written("tops"), heard, track)
        split = lines.split_words(words_of_segments(said), heard.select("job_id", "run_speaker", "gaps", "n_lines"), keep=True, parts=parts)
        return lines.lines(split, lines.history_gaps(split).alias("gaps")).select("job_id", "line_no", "speaker", "start_ms", "end_ms", "text", "gaps")

    reached = words.groupBy("job_id").agg(F.max("end_ms").alias("reached"))
    ahead = turns.join(reached, "job_id", "left").where(F.col("reached").isNull() | (F.col("end_ms") > F.col("reached"))).drop("reached")

    def after(written) -> DataFrame:
        now = written("piece_lines").groupBy("job_id").agg(F.max_by(F.struct(F.col("speaker").alias("run_speaker"), "gaps", (F.col("line_no") + 1).alias("n_lines")), "line_no").alias("last"))
        latest = written("tops").where("top is not null").groupBy("job_id").agg(F.max_by("top", "chunk_ix").alias("now"))
        both = now.join(latest, "job_id", "left").join(heard.select("job_id", "last_speaker"), "job_id", "left")
        both = both.select("job_id", F.coalesce("now", "last_speaker").alias("last_speaker"), "last.run_speaker", "last.gaps", "last.n_lines")
        return both.unionByName(heard.join(now.select("job_id"), "job_id", "left_anti"))

    return {"tops": tops, "piece_lines": made}, {"turns": ahead, "heard": after}


# ---- names that come later ---------------------------------------------------------------------------------------

SPOKEN = "recording bigint, line_ix bigint, voice string"
SHOWN = "recording bigint, line_ix bigint, voice string, display string"


def relabel_step(batch: DataFrame, ledger: Ledger, names: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Lines (recording, line_ix, voice) under the names that their voices have now, and again those of earlier batches whose
    voice got another name since. names: (recording, voice, name), read anew for each batch; without a name a voice shows its id."""
    key = ["recording", "voice"]
    now = names.select(*key, F.col("name").alias("display"))
    before = ledger.state("names", "recording bigint, voice string, display string")
    shown = F.coalesce("display", "voice")
    new = batch.select("recording", "line_ix", "voice").join(now, key, "left")
    old, fresh = before.withColumnRenamed("display", "was"), now.withColumnRenamed("display", "is")
    changed = old.join(fresh, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select(*key, F.col("is").alias("display"))
    again = ledger.read("spoken", SPOKEN).drop("batch").join(changed, key)
    out = new.unionByName(again).select("recording", "line_ix", "voice", shown.alias("display"))
    return {"shown": out, "spoken": batch.select("recording", "line_ix", "voice")}, {"names": now}


def displayed(ledger: Ledger) -> DataFrame:
    """The latest display of each line: what a keyed sink holds."""
    return ledger.read("shown", SHOWN).groupBy("recording", "line_ix").agg(F.max_by("display", "batch").alias("display"), F.count("*").alias("n_shown"))


# ---- sections ----------------------------------------------------------------------------------------------------

SECTIONED = "recording bigint, batch_no bigint, seq bigint, start_ms bigint, end_ms bigint, p_milli bigint, section bigint"


def sections_step(batch: DataFrame, ledger: Ledger, longest: int = 150_000, shortest: int = 20_000) -> tuple[dict, dict]:
    """Lines (recording, seq, start_ms, end_ms, p_milli) in sections: step batches are cut anew in each batch of the stream, as a quiet
    meeting's are when they grow stale, and sections go on from those that are open. The model's answers are stand-ins, as in
    the query of finished logs."""
    cut = runs(batch.select("recording", "seq", "start_ms", "end_ms", "p_milli"), ["recording"], ["start_ms", "seq"], live.STEP_MS, "batch")
    first = cut.groupBy("recording", "batch").agg(F.min(F.struct("start_ms", "seq", "p_milli")).alias("f"), F.count("*").alias("n"))
    answers = first.select("recording", "batch", "f.p_milli", (F.col("f.seq") % F.col("n")).alias("first_new"))
    before = ledger.state("open", live.SECTION)
    out, after = live.sections(cut.select("recording", "batch", "start_ms", "end_ms", "seq", "p_milli"), answers, longest, shortest, before=before)
    return {"sectioned": out.withColumnRenamed("batch", "batch_no")}, {"open": after}
