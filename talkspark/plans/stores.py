"""Queries of readers, writers and streams, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import scalars
from talkspark.plans import meetings, transcripts, views
from talkspark.plans.oracle_views import sql
from talkspark.sources import files
from talkspark.sources.shared import new_path
from talkspark.streaming import following
from talkspark.streaming import live as streams
from talkspark.streaming.ledger import Ledger, follow

ROUND = lambda c: F.round(c / 1000, 3)


def job_documents(spark, sf):
    """A job document for each conversation; every tenth is broken, every third of an older version."""
    t = views.conv_turns(spark, sf)
    turn = F.struct("turn", F.struct("speaker", ROUND(F.col("start_ms")).alias("start"), ROUND(F.col("end_ms")).alias("end")).alias("t"))
    j = t.groupBy("job_id").agg(F.array_sort(F.collect_list(turn)).alias("d"))
    result = F.struct(F.col("job_id").cast("string").alias("job_id"), F.size("d").alias("num_speakers"))
    doc = F.to_json(F.struct(result.alias("result"), F.col("d.t").alias("diarization"), F.when(F.col("job_id") % 3 != 0, F.lit(False)).alias("transcribed")))
    return j.select("job_id", F.when(F.col("job_id") % 10 == 9, F.substring(doc, 1, 40)).otherwise(doc).alias("value"))


def stored_jobs(spark, sf):
    """Job documents over several lines each, a folder for each; every tenth is broken."""
    path = new_path(spark, "jobs")
    # a document with line breaks is a file of its own
    spread = F.regexp_replace("value", r'(,"diarization")', "\n$1\n")
    docs = job_documents(spark, sf)
    docs.select(F.col("job_id").alias("job"), spread.alias("value")).repartition("job").write.partitionBy("job").text(path)
    return path


def s1(spark, sf):
    jobs, _ = files.read_jobs(spark, f"{stored_jobs(spark, sf)}/*/*.txt")
    return jobs.select("job_id", F.col("mtime").isNotNull().alias("has_time"), "transcribed", F.size("diarization").alias("n_turns"), F.size("speaker_labels").alias("n_labels"))


def s1_rejected(spark, sf):
    _, bad = files.read_jobs(spark, f"{stored_jobs(spark, sf)}/*/*.txt")
    return bad.select(F.regexp_extract("file", r"job=(\d+)", 1).cast("bigint").alias("job_id"))


def s2(spark, sf):
    path = new_path(spark, "diarization")
    t = views.turns(spark, sf)
    turn = F.struct("turn_ix", F.struct("speaker", ROUND(F.col("start_ms")).alias("start"), ROUND(F.col("end_ms")).alias("end")).alias("t"))
    d = t.groupBy("job_id").agg(F.array_sort(F.collect_list(turn)).alias("d"))
    d.select(F.col("job_id").cast("string").alias("job_id"), F.when(F.col("job_id") % 7 == 0, 2).otherwise(1).alias("version"), F.col("d.t").alias("segments")).write.json(path)
    return files.read_diarization(spark, path)[0].select("job_id", "speaker", "start_ms", "end_ms")


def s3(spark, sf):
    texts = files.transcript_texts(transcripts.transcript(spark, sf), headers(spark, sf))
    return files.parse_transcripts(texts.select(F.col("job_id").alias("doc"), "text")).select("doc", "start_ms", "end_ms", "speaker", "text")


def headers(spark, sf):
    t = views.conv_turns(spark, sf)
    h = t.groupBy("job_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    note = F.when(F.col("job_id") % 4 == 0, F.lit("first\nsecond"))
    return h.select("job_id", scalars.frontmatter(F.concat(F.lit('Job "'), F.col("job_id").cast("string"), F.lit('"')), F.lit("2024-01-02"), F.col("speakers"), note).alias("header"))


def f5(spark, sf):
    return headers(spark, sf)


def s4(spark, sf):
    path = new_path(spark, "transcripts")
    t = views.conv_turns(spark, sf)
    seg = F.struct("turn", F.struct("speaker", ROUND(F.col("start_ms")).alias("start"), ROUND(F.col("end_ms")).alias("end"), "text").alias("s"))
    d = t.groupBy("job_id").agg(F.array_sort(F.collect_list(seg)).alias("d"))
    job = F.col("job_id").cast("string")
    bare = d.where("job_id % 2 = 0").select(F.to_json(F.struct(job.alias("job_id"), F.col("d.s").alias("segments"))).alias("value"))
    wrapped = d.where("job_id % 2 = 1").select(F.to_json(F.struct(F.struct(job.alias("job_id"), F.col("d.s").alias("segments")).alias("result"))).alias("value"))
    bare.unionByName(wrapped).write.text(path)
    return files.read_transcript_json(spark, path).select("job_id", "seg_no", "speaker", "start_ms", "end_ms", "text")


def s7(spark, sf):
    """A registry document for each name, half of them of the flat older form."""
    m = views.voice_members(spark, sf)
    member = F.struct(F.col("job_id").cast("string").alias("job_id"), "speaker_id", "embedding", "weight")
    v = m.groupBy("namespace", "name").agg(F.collect_list(member).alias("members"), F.min_by("embedding", "added").alias("embedding"), F.count("*").cast("double").alias("count"))
    new = v.where("name < 'voice_5'").select(F.to_json(F.struct(F.create_map("namespace", F.create_map("name", F.struct("members"))).alias("speakers_by_source"))).alias("value"))
    old = v.where("name >= 'voice_5'").select(F.to_json(F.struct(F.create_map("name", F.struct("embedding", "count")).alias("speakers"))).alias("value"))
    return files.parse_registry(new.unionByName(old), "old:64").groupBy("namespace", "name").agg(F.count("*").alias("n_members"), F.sum("weight").alias("weight"))


def s8(spark, sf):
    path = new_path(spark, "recordings")
    views.table(spark, sf, "documents").where("text is not null").select("source", "text").write.partitionBy("source").text(path)
    return files.read_catalogue(spark, path).groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("dir")).agg(F.sum("length").alias("bytes"))


def s9(spark, sf):
    return files.transcript_texts(transcripts.transcript(spark, sf), headers(spark, sf).withColumn("header", F.lit("")))


def s10(spark, sf):
    s = views.segment_words(spark, sf).groupBy("job_id", "seg_no", "speaker").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    jobs = views.conv_turns(spark, sf).groupBy("job_id").agg(F.max("end_ms").alias("duration_ms")).withColumn("language", F.lit(None).cast("string"))
    made = files.transcript_json(s, jobs).select("job_id", F.from_json("json", f"struct<duration_seconds:double,speakers:array<string>,segments:array<{files.SEGMENT}>>").alias("d"))
    return made.select("job_id", F.col("d.duration_seconds").alias("duration_seconds"), F.array_join("d.speakers", ",").alias("speakers"), F.size("d.segments").cast("long").alias("n_segments"), F.size(F.filter("d.segments", lambda x: x["speaker"].isNull())).cast("long").alias("n_unknown"))


def s11(spark, sf):
    t = views.turns(spark, sf)
    gone = t.where("job_id % 4 = 0 AND speaker = 'assistant'").select("job_id", "speaker").distinct()
    made = files.diarization_json(t, gone)
    return made.select("job_id", F.posexplode(F.from_json("json", f"struct<segments:array<{files.TURN}>>")["segments"]).alias("place", "t")).select("job_id", "place", "t.speaker", "t.start", "t.end")


def s13(spark, sf):
    path = new_path(spark, "cases")
    r = meetings.eval_rows(spark, sf)
    r.select(F.col("case_id").alias("id"), F.when(F.col("case_id") % 3 == 0, F.col("category")).alias("category"), F.when(F.col("case_id") % 2 == 0, F.col("output")).alias("raw_transcript"), F.when(F.col("case_id") % 4 == 1, F.concat(F.lit("t: "), "output")).alias("transcript"), F.col("expected").alias("input"), "expected").write.json(path)
    raw = spark.read.schema("id bigint, category string, input string, raw_transcript string, transcript string, expected string").json(path)
    return files.eval_cases(raw).select("id", "category", "raw_transcript")


def s14(spark, sf):
    r = views.recordings(spark, sf).select("job_id")
    n = r.where("job_id % 3 = 0").withColumn("note", F.when(F.col("job_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" note "), F.col("job_id").cast("string"))))
    return files.with_notes(r, n)


def t1_stream(spark, sf):
    """The lines that a stream releases from files of lines, a few files to a batch."""
    source, ledger = new_path(spark, "live-lines"), Ledger(spark, new_path(spark, "released"))
    rows = meetings.covered_lines(spark, sf)
    rows.repartitionByRange(4, "seq").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    # a join of the batch's rows with small states; typed state costs a Python call for each recording and batch
    follow(stream, ledger, following.release_step)
    return ledger.read("lines", following.LINE).drop("batch")


def s6(spark, sf):
    """The event log written as JSON lines and replayed as a stream."""
    source, out = new_path(spark, "events"), new_path(spark, "replayed")
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("type"), F.lit("{}").alias("payload"))
    e.repartitionByRange(4, "seq").write.json(source)
    streams.run_available(streams.read_events(spark, source, 2).select("session", "seq", "type"), out, new_path(spark, "replayed-state"))
    return spark.read.schema("session bigint, seq bigint, type string").parquet(out)


def t12(spark, sf):
    return streams.latest_voices(meetings.t5(spark, sf)).select("recording", "voice", "window_ix")


def t11(spark, sf):
    """A batch of lines that comes twice changes nothing."""
    rows = meetings.covered_lines(spark, sf).select("recording", "track", "seq", "start_ms")
    first = rows.where("seq % 3 <> 0")
    again = rows.where("seq % 3 <> 1").withColumn("start_ms", F.col("start_ms") + 1)
    once = streams.upserted(first, again, ["recording", "track", "seq"])
    return streams.upserted(once, again, ["recording", "track", "seq"])


QUERIES = {
    "s1_job_archive": s1, "s1_rejected_jobs": s1_rejected, "s2_diarizer_output": s2, "s3_transcript_text": s3, "s4_transcript_json": s4, "s6_event_log": s6, "s7_voice_registry": s7, "s8_catalogue": s8, "s9_transcript_files": s9, "s10_transcript_json": s10, "s11_diarization_json": s11, "s13_eval_cases": s13, "s14_notes": s14,
    "f5_frontmatter": f5, "t1_release_stream": t1_stream, "t11_upserted_lines": t11, "t12_latest_voices": t12,
}
HEAD = """h AS (SELECT job_id, '---' || chr(10) || 'title: "Job \\"' || job_id || '\\""' || chr(10) || 'date: "2024-01-02"' || chr(10) || 'speakers: ["' || string_agg(DISTINCT speaker, '","' ORDER BY speaker) || '"]' || CASE WHEN job_id % 4 = 0 THEN chr(10) || 'note: |' || chr(10) || '  first' || chr(10) || '  second' ELSE '' END || chr(10) || '---' || chr(10) AS header FROM conv_turns GROUP BY job_id)"""
ORACLES = {
    "s1_job_archive": sql("SELECT job_id::VARCHAR AS job_id, true AS has_time, job_id % 3 = 0 AS transcribed, count(*)::INT AS n_turns, 0 AS n_labels FROM conv_turns WHERE job_id % 10 <> 9 GROUP BY job_id", "conv_turns"),
    "s1_rejected_jobs": sql("SELECT DISTINCT job_id FROM conv_turns WHERE job_id % 10 = 9", "conv_turns"),
    "s2_diarizer_output": sql("SELECT job_id::VARCHAR AS job_id, speaker, start_ms, end_ms FROM turns WHERE job_id % 7 <> 0", "turns"),
    "s3_transcript_text": sql("""SELECT doc, start_ms, CASE WHEN nx > start_ms THEN least(g, nx) ELSE g END AS end_ms, speaker, text FROM (SELECT job_id AS doc, start_ms // 1000 * 1000 AS start_ms, start_ms // 1000 * 1000 + greatest(1000, 400 * len(string_split(text, ' '))) AS g,
 lead(start_ms // 1000 * 1000) OVER (PARTITION BY job_id ORDER BY line_no) AS nx, speaker, text FROM lines)""", "lines"),
    "s4_transcript_json": sql("SELECT job_id::VARCHAR AS job_id, (row_number() OVER (PARTITION BY job_id ORDER BY turn) - 1)::INT AS seg_no, speaker, start_ms, end_ms, text FROM conv_turns", "conv_turns"),
    "s6_event_log": "SELECT user_id AS session, event_id AS seq, event_type AS type FROM events",
    "s7_voice_registry": sql("SELECT CASE WHEN name < 'voice_5' THEN 'test:64' ELSE 'old:64' END AS namespace, name, CASE WHEN name < 'voice_5' THEN count(*) ELSE 1 END AS n_members, count(*)::DOUBLE AS weight FROM members GROUP BY name", "members"),
    "s8_catalogue": "SELECT source AS dir, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source",
    "s9_transcript_files": sql(f"SELECT job_id, string_agg('[' || {transcripts.CLOCK} || '] ' || speaker || ': ' || text, chr(10) ORDER BY line_no) || chr(10) AS text, count(*) AS n_lines FROM lines GROUP BY job_id", "lines"),
    "s10_transcript_json": sql("""SELECT s.job_id, round(d / 1000, 3) AS duration_seconds, coalesce(string_agg(DISTINCT CASE WHEN speaker <> 'UNKNOWN' THEN speaker END, ',' ORDER BY CASE WHEN speaker <> 'UNKNOWN' THEN speaker END), '') AS speakers, count(*) AS n_segments, count(*) FILTER (WHERE speaker = 'UNKNOWN') AS n_unknown
 FROM segs s JOIN (SELECT job_id, max(end_ms) AS d FROM conv_turns GROUP BY job_id) j ON s.job_id = j.job_id GROUP BY s.job_id, d""", "segs"),
    "s11_diarization_json": sql("SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY start_ms, speaker, end_ms) - 1)::INT AS place, speaker, round(start_ms / 1000, 3) AS start, round(end_ms / 1000, 3) AS \"end\" FROM turns WHERE NOT (job_id % 4 = 0 AND speaker = 'assistant')", "turns"),
    "s13_eval_cases": sql(", eo AS (SELECT *, job_id * 100 + turn AS id, array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 7 <> 6), ' ') AS output FROM conv_turns WHERE n_words > 0) SELECT id, CASE WHEN id % 3 = 0 AND job_id % 5 = 0 THEN 'mixed_task' ELSE 'quality' END AS category, CASE WHEN id % 2 = 0 THEN output WHEN id % 4 = 1 THEN 't: ' || output ELSE text END AS raw_transcript FROM eo", "conv_turns").replace("\n, eo AS", ",\neo AS"),
    "s14_notes": sql("SELECT job_id, CASE WHEN job_id % 3 = 0 AND job_id % 2 <> 0 THEN 'note ' || job_id END AS note FROM recordings", "recordings"),
    "f5_frontmatter": sql(", " + HEAD + " SELECT job_id, header FROM h", "conv_turns").replace("\n, h AS", ",\nh AS"),
    "t1_release_stream": meetings.with_cte(meetings.COVER, """, top AS (SELECT recording, least(max(covered_ms) FILTER (WHERE track = 'mic'), max(covered_ms) FILTER (WHERE track = 'system')) AS level, count(DISTINCT track) AS n FROM cv GROUP BY recording)
SELECT cv.recording, track, seq, start_ms, end_ms FROM cv JOIN top ON cv.recording = top.recording WHERE n = 2 AND start_ms < level""", "live"),
    "t11_upserted_lines": meetings.with_cte(meetings.COVER, "SELECT recording, track, seq, CASE WHEN seq % 3 <> 1 THEN start_ms + 1 ELSE start_ms END AS start_ms FROM cv", "live"),
}
