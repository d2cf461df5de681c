"""Readers and writers of meeting files. Times in files are seconds; tables have whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.functions.scalars import UNKNOWN, blank_to_null

WORD = "struct<word:string,start:double,end:double,speaker:string,resolved_label:string>"
SEGMENT = f"struct<speaker:string,resolved_label:string,speaker_confidence:double,start:double,end:double,text:string,words:array<{WORD}>>"
TURN = "struct<speaker:string,start:double,end:double>"
RESULT = f"struct<job_id:string,language:string,duration_seconds:double,num_speakers:int,segments:array<{SEGMENT}>,warnings:array<string>>"
JOB = (
    f"result {RESULT}, diarization array<{TURN}>, speaker_embeddings map<string,array<double>>, source_path string, source_fingerprint string,"
    " speaker_labels map<string,string>, excluded_speakers array<string>, excluded_lines array<struct<speaker:string,start:double>>, transcribed boolean, _corrupt string"
)
ms = lambda c: F.round(c * 1000).cast("long")


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Job documents (one JSON file each) as rows, and those that can't be used. Fields of later versions get defaults."""
    raw = spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.withColumns({"file": F.col("_metadata.file_path"), "mtime": F.col("_metadata.file_modification_time")})
    fine = F.col("_corrupt").isNull() & F.col("result.job_id").isNotNull()
    empty = lambda c, kind: F.coalesce(c, F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind))
    jobs = raw.where(fine).select(
        F.col("result.job_id").alias("job_id"), "result", "file", "mtime", "source_path", "source_fingerprint", empty(F.col("diarization"), f"array<{TURN}>").alias("diarization"),
        empty(F.col("speaker_embeddings"), "map<string,array<double>>").alias("speaker_embeddings"), empty(F.col("speaker_labels"), "map<string,string>").alias("speaker_labels"),
        empty(F.col("excluded_speakers"), "array<string>").alias("excluded_speakers"), empty(F.col("excluded_lines"), "array<struct<speaker:string,start:double>>").alias("excluded_lines"), F.coalesce("transcribed", F.lit(True)).alias("transcribed"),
    )
    return jobs, raw.where(~fine).select("file", "_corrupt")


def job_turns(jobs: DataFrame) -> DataFrame:
    t = jobs.select("job_id", F.posexplode("diarization").alias("turn_ix", "t"))
    return t.select("job_id", "turn_ix", "t.speaker", ms(F.col("t.start")).alias("start_ms"), ms(F.col("t.end")).alias("end_ms"))


def read_diarization(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns and prints of a diarizer's JSON files, and files of another version."""
    raw = spark.read.schema(f"job_id string, version int, segments array<{TURN}>, centroids map<string,array<double>>").json(path)
    fine = F.coalesce(F.col("version") == version, F.lit(False))
    good = raw.where(fine)
    turns = good.select("job_id", F.posexplode("segments").alias("turn_ix", "t")).select("job_id", "turn_ix", "t.speaker", ms(F.col("t.start")).alias("start_ms"), ms(F.col("t.end")).alias("end_ms"))
    return turns, good.select("job_id", F.explode("centroids").alias("speaker", "embedding")), raw.where(~fine).select("job_id", "version")


def parse_transcripts(texts: DataFrame) -> DataFrame:
    """Lines (doc, line_no, start_ms, end_ms, speaker, text) of texts (doc, text) such as `[0:01:05] Ann: hello`.

    A block between --- at the start is skipped. A line ends 0.4 s a word after its start, one second at least, and
    not after the next start if that is later.
    """
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    raw = texts.select("doc", F.posexplode(F.split(body, "\n")).alias("line_no", "raw"))
    part = lambda k: F.regexp_extract("raw", r"^\[(\d+):(\d\d):(\d\d)\] ([^:]+): ?(.*)$", k)
    hit = raw.where(part(4) != "").select("doc", "line_no", ((part(1).cast("long") * 60 + part(2).cast("long")) * 60 + part(3).cast("long")).alias("s"), part(4).alias("speaker"), F.trim(part(5)).alias("text"))
    n_words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", r"\s+")))
    guess = F.col("s") * 1000 + F.greatest(F.lit(1000), n_words * 400)
    after = F.lead("s").over(Window.partitionBy("doc").orderBy("line_no")) * 1000
    end = F.when(after > F.col("s") * 1000, F.least(guess, after)).otherwise(guess)
    return hit.withColumn("end_ms", end.cast("long")).where("text <> ''").select("doc", "line_no", (F.col("s") * 1000).alias("start_ms"), "end_ms", "speaker", "text")


def read_transcript_texts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text")))


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """Segments of transcript files, bare or within "result"."""
    raw = spark.read.schema(f"job_id string, segments array<{SEGMENT}>, result {RESULT}").json(path)
    job, segments = F.coalesce("result.job_id", "job_id"), F.coalesce("result.segments", "segments")
    return raw.select(job.alias("job_id"), F.posexplode(segments).alias("seg_no", "s")).select("job_id", "seg_no", "s.speaker", F.col("s.resolved_label").alias("label"), ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), "s.text")


def parse_registry(raw: DataFrame, legacy_namespace: str) -> DataFrame:
    """Members (namespace, name, job_id, speaker_id, embedding, weight, added) of registry documents in a column value.

    Older documents have one flat list of speakers, and names with one vector and a count: an anonymous member of
    that weight.
    """
    member = "struct<job_id:string,speaker_id:string,embedding:array<double>,added:string,weight:double>"
    voice = f"struct<members:array<{member}>,embedding:array<double>,count:double>"
    doc = F.from_json("value", f"struct<speakers_by_source:map<string,map<string,{voice}>>,speakers:map<string,{voice}>>")
    by_source = F.coalesce(F.col("d.speakers_by_source"), F.when(F.col("d.speakers").isNotNull(), F.create_map(F.lit(legacy_namespace), F.col("d.speakers"))))
    v = raw.select(doc.alias("d")).select(F.explode(by_source).alias("namespace", "names")).select("namespace", F.explode("names").alias("name", "v"))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("string").alias("speaker_id"), F.col("v.embedding").alias("embedding"), F.lit(None).cast("string").alias("added"), F.coalesce("v.count", F.lit(1.0)).alias("weight")))
    m = v.select("namespace", "name", F.explode(F.when(F.col("v.members").isNull(), alone).otherwise(F.col("v.members"))).alias("m"))
    return m.select("namespace", "name", "m.job_id", "m.speaker_id", "m.embedding", F.coalesce("m.weight", F.lit(1.0)).alias("weight"), "m.added").where(F.size("embedding") > 0)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Files with the SHA-256 of their bytes; bytes aren't shuffled, hashes are made in the scan. Smallest first: order by size."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("fingerprint"))


def transcript_texts(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(job_id, text, n_lines): header and rendered lines of each job; lines: job_id, line_no, line; headers: job_id, header."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    made = lines.groupBy("job_id").agg(body.alias("body"), F.count("*").alias("n_lines"))
    return headers.join(made, "job_id", "left").select("job_id", F.concat(F.coalesce("header", F.lit("")), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def seconds(c: Column) -> Column:
    return F.round(c / 1000, 3)


def transcript_json(segments: DataFrame, jobs: DataFrame, version: int = 1) -> DataFrame:
    """(job_id, json): version, job, language, duration, speakers and segments; UNKNOWN speakers are null."""
    speaker = F.nullif(F.col("speaker"), F.lit(UNKNOWN))
    seg = F.struct("start_ms", "seg_no", F.struct(speaker.alias("speaker"), seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"), F.col("text").alias("text")).alias("s"))
    s = segments.groupBy("job_id").agg(F.array_sort(F.collect_list(seg)).alias("segs"), F.array_sort(F.collect_set(speaker)).alias("speakers"))
    out = jobs.join(s, "job_id", "left")
    doc = F.struct(F.lit(version).alias("version"), "job_id", "language", seconds(F.col("duration_ms")).alias("duration_seconds"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), F.col("segs.s").alias("segments"))
    return out.select("job_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def diarization_json(turns: DataFrame, excluded: DataFrame) -> DataFrame:
    """(job_id, json): turns by (start, speaker) without excluded speakers."""
    kept = turns.join(excluded, ["job_id", "speaker"], "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "speaker", "end_ms")))
    t = kept.groupBy("job_id").agg(listed.alias("t"))
    out = F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), seconds(x["start_ms"]).alias("start"), seconds(x["end_ms"]).alias("end")))
    return t.select("job_id", F.to_json(F.struct(F.lit(1).alias("version"), out.alias("segments"))).alias("json"))


def eval_cases(raw: DataFrame) -> DataFrame:
    """Cases (id, category, input, raw_transcript, transcript, expected) with raw_transcript from the first field there is;
    without any it is an error, and the category is quality by default."""
    text = F.coalesce("raw_transcript", "transcript", "input")
    return raw.select("id", F.coalesce("category", F.lit("quality")).alias("category"), F.when(text.isNull(), F.raise_error(F.concat(F.lit("no transcript in case "), F.col("id").cast("string"))).cast("string")).otherwise(text).alias("raw_transcript"), "expected")


def with_notes(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Jobs with their note; a blank one is none."""
    return jobs.join(notes.select("job_id", blank_to_null(F.col("note")).alias("note")), "job_id", "left")
