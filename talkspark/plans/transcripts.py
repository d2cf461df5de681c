"""Queries of attribution, segments and lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions import scalars
from talkspark.operators import attribution, lines
from talkspark.operators.places import stored
from talkspark.plans import views
from talkspark.plans.oracle_views import sql

CLOCK = "lpad((greatest(start_ms // 1000, 0) % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad((greatest(start_ms // 1000, 0) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((greatest(start_ms // 1000, 0) % 60)::VARCHAR, 2, '0')"


def made_lines(spark: SparkSession, sf: str) -> DataFrame:
    parts = views.word_parts(spark, sf)
    return lines.lines(lines.split_words(views.segment_words(spark, sf, parts), parts=parts))


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    """Attributed transcript: words and turns to rendered lines."""
    return lines.rendered_lines(made_lines(spark, sf))


def w1(spark, sf):
    return attribution.utterances(views.words(spark, sf)).select("job_id", "chunk_ix", "pos", "word", "utt")


def j1(spark, sf):
    return views.spoken(spark, sf).select("job_id", "chunk_ix", "pos", "utt", "speaker")


def w2(spark, sf):
    s = views.spoken_segments(spark, sf)
    return s.select("job_id", "chunk_ix", "seg_ix", "speaker", "speaker_confidence", "start_ms", "end_ms", "text", F.size("words").cast("long").alias("n_words"))


def j2(spark, sf):
    spans = views.conv_turns(spark, sf).select("job_id", F.col("turn").alias("span_ix"), "start_ms", "end_ms")
    return attribution.dominant(spans, views.turns(spark, sf)).select("job_id", "span_ix", "speaker", F.round("speaker_confidence", 6).alias("confidence"))


def asr(spark, sf):
    """Chunks of 90 s with their text; in every third job without word times, in every tenth chunk without text."""
    w = views.words(spark, sf)
    return w.groupBy("job_id", "chunk_ix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )


def j3(spark, sf):
    parts = views.word_parts(spark, sf)
    timed = views.words(spark, sf, parts).where("job_id % 3 <> 0")
    out, _ = attribution.merged(asr(spark, sf), timed, views.turns(spark, sf), parts)
    return out.withColumn("speaker_confidence", F.round("speaker_confidence", 6))


def j3_warnings(spark, sf):
    timed = views.words(spark, sf).where("job_id % 3 <> 0")
    return attribution.merged(asr(spark, sf), timed, views.turns(spark, sf))[1]


ASR = "asr AS (SELECT job_id, chunk_ix, string_agg(word, ' ' ORDER BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY ALL)"


def w3(spark, sf):
    return made_lines(spark, sf).drop("label")


def f23(spark, sf):
    """Every fourth job is diarized only."""
    jobs = views.conv_turns(spark, sf).select("job_id").distinct().withColumn("transcribed", F.col("job_id") % 4 != 0)
    heard = views.turns(spark, sf)
    parts = views.word_parts(spark, sf)
    words = views.words(spark, sf, parts).where("job_id % 4 <> 0")
    return attribution.job_results(jobs, heard, attribution.segments(attribution.attributed(words, heard, parts=parts), parts))


def w5(spark, sf):
    s = views.spoken_segments(spark, sf).withColumn("seg_no", F.col("chunk_ix") * 100000 + F.col("seg_ix"))
    return lines.sentence_lines(s)


def w4(spark, sf):
    chunks, words = overlapping(spark, sf)
    return attribution.without_overlap(chunks, words)[0].select("job_id", "chunk_ix", "text", "start_ms", "end_ms")


def w4_words(spark, sf):
    chunks, words = overlapping(spark, sf)
    return attribution.without_overlap(chunks, words)[1].select("job_id", "chunk_ix", "pos", "word")


def overlapping(spark, sf):
    """Words of 90 s chunks, and once more those of the last 5 s of each chunk in the next one."""
    w = views.words(spark, sf)
    again = w.where("start_ms % 90000 >= 85000").withColumn("chunk_ix", F.col("chunk_ix") + 1)
    both = w.unionByName(again)
    chunks = both.groupBy("job_id", "chunk_ix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), ((F.col("chunk_ix") + 1) * 90000).alias("end_ms")
    )
    return chunks, both


OVERLAP = """bw AS (SELECT * FROM words UNION ALL SELECT job_id, chunk_ix + 1, pos, word, start_ms, end_ms FROM words WHERE start_ms % 90000 >= 85000),
ch AS (SELECT job_id, chunk_ix, string_agg(word, ' ' ORDER BY pos) AS text, min(start_ms) AS start_ms, (chunk_ix + 1) * 90000 AS end_ms, count(*) AS had FROM bw GROUP BY job_id, chunk_ix),
fl AS (SELECT *, max(end_ms) OVER (PARTITION BY job_id ORDER BY chunk_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM ch),
kw AS (SELECT bw.* FROM bw JOIN fl USING (job_id, chunk_ix) WHERE f IS NULL OR bw.start_ms >= f),
ks AS (SELECT job_id, chunk_ix, count(*) AS has, min(start_ms) AS fm, string_agg(word, ' ' ORDER BY pos) AS nt FROM kw GROUP BY ALL)"""


def tokens(spark, sf):
    """Every word as one or two subword tokens, by chunk."""
    w = views.words(spark, sf)
    half = F.greatest(F.lit(1), F.floor(F.length("word") / 2)).cast("int")
    parts = F.array(
        F.struct(F.col("pos").alias("p"), F.lit(0).alias("k"), F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), half)).alias("token"), F.col("start_ms").alias("s"), F.lit(150).alias("d")),
        F.struct(F.col("pos").alias("p"), F.lit(1).alias("k"), F.substring(F.col("word"), half + 1, F.length("word")).alias("token"), (F.col("start_ms") + 150).alias("s"), F.lit(150).alias("d")),
    )
    t = w.select("job_id", "chunk_ix", F.explode(parts).alias("t")).where("t.token <> ''")
    listed = t.groupBy("job_id", "chunk_ix").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("job_id", "chunk_ix", F.col("t.token").alias("tokens"), F.col("t.s").alias("starts"), F.col("t.d").alias("durations"))


def f8(spark, sf):
    return attribution.tokens_to_words(tokens(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


def f9(spark, sf):
    w = views.words(spark, sf)
    own = w.withColumns({"start_ms": F.col("start_ms") - F.col("chunk_ix") * 90000, "end_ms": F.col("end_ms") - F.col("chunk_ix") * 90000})
    chunks = w.select("job_id", "chunk_ix").distinct().withColumns({"start_ms": F.col("chunk_ix") * 90000, "end_ms": (F.col("chunk_ix") + 1) * 90000})
    return attribution.on_recording_clock(own, chunks).select("job_id", "chunk_ix", "pos", "word", "start_ms", "end_ms")


def gone(spark, sf):
    """Lines, made once and kept, and what is removed: assistants of every fourth job; lines that start at an even second."""
    made = stored(made_lines(spark, sf), "lines")
    speakers = views.turns(spark, sf).where("job_id % 4 = 0 AND speaker = 'assistant'").select("job_id", "speaker").distinct()
    keys = made.where("start_ms % 2000 = 0").select("job_id", "speaker", "start_ms")
    return made, speakers, keys


def j8(spark, sf):
    return lines.without_removed(*gone(spark, sf)).select("job_id", "line_no", "speaker", "start_ms")


def j9(spark, sf):
    return lines.flagged(*gone(spark, sf)).select("job_id", "line_no", "removed")


GONE = "(job_id % 4 = 0 AND speaker = 'assistant' AND EXISTS (SELECT 1 FROM turns t WHERE t.job_id = lines.job_id AND t.speaker = 'assistant')) OR start_ms % 2000 = 0"


def a12(spark, sf):
    f = lines.flagged(*gone(spark, sf))
    return f.groupBy("job_id").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"))


def w8(spark, sf):
    from talkspark.operators.samples import first_lines

    return first_lines(lines.without_removed(*gone(spark, sf))).select("job_id", "speaker", "hint_no", "text")


def f_scalars(spark, sf):
    """Display name, clock, file name and slug over turns."""
    t = views.conv_turns(spark, sf)
    label = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.initcap("speaker"), F.lit("/"), F.col("job_id").cast("string"), F.lit(" "))).when(F.col("turn") % 3 == 1, F.lit("  "))
    return t.select(
        "job_id", "turn", scalars.display_name(label, F.col("speaker")).alias("display"), scalars.clock(F.col("start_ms") * 50).alias("clock"),
        scalars.safe_file_name(label).alias("file"), scalars.slug(label).alias("slug"), scalars.suggestion_suffix(F.lit(None).cast("string"), F.when(F.col("turn") % 2 == 0, F.col("speaker")), F.col("turn") / 8).alias("sample"),
    )


def f20(spark, sf):
    """Length-ratio score of whole texts without some short words, throughput and fragment test over documents."""
    d = views.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    out = F.regexp_replace("text", " (the|of|and|und|de) ", " ")
    return d.select(
        "doc_id", F.round(scalars.granularity(F.lit(1.0), out, F.col("text")), 6).alias("granularity"),
        F.round(scalars.per_second(F.col("n_chars"), F.col("doc_id") % 7), 6).alias("chars_per_second"),
        scalars.contains_any(F.col("text"), F.array(F.lit("THE "), F.lit("und "))).alias("found"),
    )


def f2(spark, sf):
    """Line keys of turns: float noise in the start, in seconds, doesn't change them."""
    t = views.conv_turns(spark, sf)
    noisy = F.col("start_ms") / 1000 + F.when(F.col("turn") % 2 == 0, 1e-9).otherwise(-1e-9)
    return t.select("job_id", "turn", scalars.line_key_of_seconds(F.col("speaker"), noisy).alias("k")).select("job_id", "turn", "k.*")


def f15(spark, sf):
    """What a model may say of each turn: with thoughts, fences and prose around the object, a lone closing tag, or no object at all."""
    t = views.conv_turns(spark, sf)
    own = F.concat(F.lit('{"p": 0.'), (F.col("turn") + 1).cast("string"), F.lit(', "choice": "L'), F.col("turn").cast("string"), F.lit('"}'))
    reply = (
        F.when(F.col("turn") % 5 == 0, own).when(F.col("turn") % 5 == 1, F.concat(F.lit('<think>maybe {"p": 9}</think>\n```json\n'), own, F.lit("\n```")))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit('first {"p": 8} no</think>Here it is: '), own, F.lit(" as asked."))).when(F.col("turn") % 5 == 3, F.concat(F.lit("Sure.\n"), own, F.lit('\n{"p": 7}'))).otherwise(F.lit("I can't say."))
    )
    return t.select("job_id", "turn", scalars.reply_json(reply, "p double, choice string").alias("r")).select("job_id", "turn", "r.*")


def f19(spark, sf):
    """Days of recordings: when they were made, else when their file was written."""
    e = views.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    made = F.when(F.col("event_id") % 3 != 0, F.col("ts") - F.expr("INTERVAL 36 HOURS"))
    return e.select("event_id", scalars.recording_day(made, F.col("ts")).alias("day"))


QUERIES = {
    "w1_utterances": w1, "j1_word_attribution": j1, "w2_speaker_segments": w2, "j2_dominant_speaker": j2, "j3_merged_segments": j3, "j3_warnings": j3_warnings, "w3_adaptive_lines": w3, "f4_rendered_transcript": transcript,
    "w5_sentence_lines": w5, "w4_overlap_chunks": w4, "w4_overlap_words": w4_words, "f8_token_words": f8, "f9_recording_clock": f9, "j8_without_removed": j8, "j9_removed_flags": j9, "a12_line_counts": a12, "w8_speaker_hints": w8,
    "f2_line_keys": f2, "f15_model_replies": f15, "f19_recording_day": f19, "f_names_and_clocks": f_scalars, "f20_scores": f20, "f23_diarized_only": f23,
}
ORACLES = {
    "w1_utterances": sql("SELECT job_id, chunk_ix, pos, word, utt FROM utts", "utts"),
    "j1_word_attribution": sql("SELECT job_id, chunk_ix, pos, utt, speaker FROM spoken", "spoken"),
    "w2_speaker_segments": sql("SELECT * FROM segs", "segs"),
    "j2_dominant_speaker": sql("""SELECT c.job_id, c.turn AS span_ix, coalesce(b.speaker, 'UNKNOWN') AS speaker, round(CASE WHEN b.o IS NULL THEN 0.0 ELSE least(1.0, b.o / greatest(c.end_ms - c.start_ms, 1)) END, 6) AS confidence FROM conv_turns c LEFT JOIN
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, turn ORDER BY o DESC, f) AS rn FROM (SELECT c.job_id, c.turn, t.speaker, sum(least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms)) AS o, min(t.turn_ix) AS f
 FROM conv_turns c JOIN turns t ON c.job_id = t.job_id AND c.start_ms < t.end_ms AND t.start_ms < c.end_ms GROUP BY ALL)) WHERE rn = 1) b ON c.job_id = b.job_id AND c.turn = b.turn""", "turns"),
    "j3_merged_segments": sql(""", """ + ASR + """ SELECT job_id, chunk_ix, seg_ix, speaker, speaker_confidence, start_ms, end_ms, text FROM segs WHERE job_id % 3 <> 0 UNION ALL
 SELECT a.job_id, a.chunk_ix, 0 AS seg_ix, coalesce(b.speaker, 'UNKNOWN'), round(CASE WHEN b.o IS NULL THEN 0.0 ELSE least(1.0, b.o / greatest(a.end_ms - a.start_ms, 1)) END, 6), a.start_ms, a.end_ms, trim(a.text) FROM asr a LEFT JOIN
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, chunk_ix ORDER BY o DESC, f) AS rn FROM (SELECT a.job_id, a.chunk_ix, t.speaker, sum(least(a.end_ms, t.end_ms) - greatest(a.start_ms, t.start_ms)) AS o, min(t.turn_ix) AS f
 FROM asr a JOIN turns t ON a.job_id = t.job_id AND a.start_ms < t.end_ms AND t.start_ms < a.end_ms GROUP BY ALL)) WHERE rn = 1) b USING (job_id, chunk_ix) WHERE a.job_id % 3 = 0""", "segs").replace("\n, asr AS", ",\nasr AS"),
    "j3_warnings": sql("SELECT DISTINCT job_id, 'no word times: one speaker for the whole segment' AS warning FROM words WHERE job_id % 3 = 0", "words"),
    "w3_adaptive_lines": sql("SELECT * FROM lines", "lines"),
    "f4_rendered_transcript": sql(f"SELECT job_id, line_no, '[' || {CLOCK} || '] ' || speaker || ': ' || text AS line FROM lines", "lines"),
    "w5_sentence_lines": sql(""", s AS (SELECT *, chunk_ix * 100000 + seg_ix AS seg_no, regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM segs),
p AS (SELECT job_id, seg_no, speaker, start_ms, end_ms, unnest(ps) AS text, unnest(range(len(ps))) AS part FROM s),
q AS (SELECT *, sum(length(text)) OVER (PARTITION BY job_id, seg_no ORDER BY part) AS upto, sum(length(text)) OVER (PARTITION BY job_id, seg_no) AS whole FROM p WHERE text <> '')
SELECT job_id, seg_no, part::INT AS part, speaker, start_ms + round((end_ms - start_ms) * (upto - length(text)) / whole)::BIGINT AS line_start, start_ms + round((end_ms - start_ms) * upto / whole)::BIGINT AS line_end, text FROM q""", "segs").replace("\n, s AS", ",\ns AS"),
    "w4_overlap_chunks": sql(", " + OVERLAP + " SELECT job_id, chunk_ix, CASE WHEN has < had THEN nt ELSE text END AS text, CASE WHEN has < had THEN fm ELSE start_ms END AS start_ms, end_ms FROM ch JOIN ks USING (job_id, chunk_ix)", "words").replace("\n, bw AS", ",\nbw AS"),
    "w4_overlap_words": sql(", " + OVERLAP + " SELECT job_id, chunk_ix, pos, word FROM kw", "words").replace("\n, bw AS", ",\nbw AS"),
    "f8_token_words": sql("SELECT job_id, chunk_ix, row_number() OVER (PARTITION BY job_id, chunk_ix ORDER BY pos) - 1 AS pos, word, start_ms, CASE WHEN length(word) > 1 THEN start_ms + 300 ELSE start_ms + 150 END AS end_ms FROM words", "words"),
    "f9_recording_clock": sql("SELECT job_id, chunk_ix, pos, word, start_ms, least(end_ms, (chunk_ix + 1) * 90000) AS end_ms FROM words", "words"),
    "j8_without_removed": sql(f"SELECT job_id, line_no, speaker, start_ms FROM lines WHERE NOT ({GONE})", "lines"),
    "j9_removed_flags": sql(f"SELECT job_id, line_no, ({GONE}) AS removed FROM lines", "lines"),
    "a12_line_counts": sql(f"SELECT job_id, count(*) AS n_lines, count(*) FILTER (WHERE {GONE}) AS n_removed FROM lines GROUP BY job_id", "lines"),
    "w8_speaker_hints": sql(f"SELECT job_id, speaker, hint_no, text FROM (SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY start_ms, line_no)::INT AS hint_no FROM lines WHERE NOT ({GONE})) WHERE hint_no <= 3", "lines"),
    "f2_line_keys": sql("SELECT job_id, turn, speaker, start_ms FROM conv_turns", "conv_turns"),
    "f15_model_replies": sql("SELECT job_id, turn, CASE WHEN turn % 5 <> 4 THEN ('0.' || (turn + 1))::DOUBLE END AS p, CASE WHEN turn % 5 <> 4 THEN 'L' || turn END AS choice FROM conv_turns", "conv_turns"),
    "f19_recording_day": "SELECT event_id, strftime(CASE WHEN event_id % 3 <> 0 THEN ts - INTERVAL 36 HOURS ELSE ts END, '%Y-%m-%d') AS day FROM events",
    "f_names_and_clocks": sql("""SELECT job_id, turn, coalesce(nullif(trim(label), ''), speaker) AS display, """ + CLOCK.replace("start_ms", "(start_ms * 50)") + """ AS clock, coalesce(nullif(trim(replace(label, '/', '-')), ''), 'NAME-ME') AS file,
 substr(regexp_replace(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) AS slug, CASE WHEN turn % 2 = 0 THEN speaker || '_' || printf('%.2f', turn / 8) ELSE 'NAME-ME' END AS sample
 FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN '  ' || upper(speaker[1]) || speaker[2:] || '/' || job_id || ' ' WHEN turn % 3 = 1 THEN '  ' END AS label FROM conv_turns)""", "conv_turns"),
    "f23_diarized_only": sql("""SELECT j.job_id, j.job_id % 4 <> 0 AS transcribed, coalesce(n_turns, 0) AS n_turns, coalesce(n_speakers, 0) AS n_speakers, coalesce(n_segments, 0) AS n_segments FROM (SELECT DISTINCT job_id FROM conv_turns) j
 LEFT JOIN (SELECT job_id, count(*) AS n_turns, count(DISTINCT speaker) AS n_speakers FROM turns GROUP BY job_id) t USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n_segments FROM segs WHERE job_id % 4 <> 0 GROUP BY job_id) s USING (job_id)""", "segs"),
    "f20_scores": """SELECT doc_id, round(greatest(0.0, 1.0 - abs(length(regexp_replace(text, ' (the|of|and|und|de) ', ' ', 'g')) - length(text)) / greatest(length(text), 1)), 6) AS granularity,
 round(CASE WHEN doc_id % 7 > 0 THEN n_chars / (doc_id % 7) END, 6) AS chars_per_second, contains(lower(text), 'the ') OR contains(lower(text), 'und ') AS found FROM documents""",
}
