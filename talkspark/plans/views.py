"""Meeting tables derived from the given tables, in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.functions.scalars import normalised
from talkspark.operators import attribution
from talkspark.operators.places import dealt, parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the words of all conversations, which are counted in a pass of their own."""
    n = table(spark, sf_dir, "conversations").agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    return parts_for(spark, n)


def conv_turns(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """A meeting for each conversation: 400 ms a word, a pause of 800 ms every 11 words, 700 ms between turns."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), "turn", F.col("role").alias("speaker"), normalised(F.col("text")).alias("text"))
    c = c.withColumn("n_words", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).cast("long"))
    c = c.withColumn("dur_ms", 400 * F.col("n_words") + 800 * F.floor(F.col("n_words") / 11))
    c = dealt(c, parts, "job_id")
    before = Window.partitionBy("job_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("start_ms", F.coalesce(F.sum(F.col("dur_ms") + 700).over(before), F.lit(0)))
    return c.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))


def words(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    w = conv_turns(spark, sf_dir, parts or word_parts(spark, sf_dir)).where("n_words > 0").select("job_id", "turn", F.col("start_ms").alias("t"), F.posexplode(F.split("text", " ")).alias("ix", "word"))
    w = w.withColumn("start_ms", F.col("t") + 400 * F.col("ix") + 800 * F.floor(F.col("ix") / 11))
    return w.select("job_id", F.floor(F.col("start_ms") / 90000).alias("chunk_ix"), F.col("start_ms").alias("pos"), "word", "start_ms", (F.col("start_ms") + 300).alias("end_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a diarizer may have heard: some turns late at the start or long at the end, empty ones gone."""
    t = conv_turns(spark, sf_dir)
    start = F.col("start_ms") + F.when(F.col("turn") % 3 == 1, 1000).otherwise(0) + F.when(F.col("turn") % 4 == 3, 6000).otherwise(0)
    end = F.col("end_ms") + F.when(F.col("turn") % 2 == 1, 1500).otherwise(0)
    return t.select("job_id", F.col("turn").alias("turn_ix"), "speaker", start.alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms")


def spoken(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Words with utterance and speaker."""
    parts = parts or word_parts(spark, sf_dir)
    return attribution.attributed(words(spark, sf_dir, parts), turns(spark, sf_dir), parts=parts)


def spoken_segments(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    parts = parts or word_parts(spark, sf_dir)
    return attribution.segments(spoken(spark, sf_dir, parts), parts)


def segment_words(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Words of segments: the transcript's turns are its segments here."""
    seg = spoken_segments(spark, sf_dir, parts)
    w = seg.withColumn("seg_no", F.col("chunk_ix") * 100000 + F.col("seg_ix")).select("job_id", "seg_no", "speaker", F.explode("words").alias("w"))
    return w.select("job_id", "seg_no", "speaker", F.lit(None).cast("string").alias("label"), "w.pos", "w.word", "w.start_ms", "w.end_ms")


def big_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large turn table: an order is a recording, its lines are turns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem")
    t = dealt(items, parts_for(spark, items.count()), "l_orderkey").select(
        F.col("l_orderkey").alias("job_id"), F.row_number().over(order).alias("turn_ix"), F.concat(F.lit("SPEAKER_"), (F.col("l_suppkey") % 4).cast("string")).alias("speaker"), "l_quantity"
    )
    t = t.withColumn("start_ms", (60000 * F.col("turn_ix")).cast("long"))
    return t.select("job_id", "turn_ix", "speaker", "start_ms", (F.col("start_ms") + (1000 * F.col("l_quantity")).cast("long")).alias("end_ms"))


def voice_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0")
    return e.select(
        F.lit("test:64").alias("namespace"), F.concat(F.lit("voice_"), F.col("label").cast("string")).alias("name"), F.floor(F.col("vec_id") / 10).alias("job_id"),
        F.concat(F.lit("SPEAKER_"), (F.col("vec_id") % 10).cast("string")).alias("speaker_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1.0).alias("weight"), F.col("vec_id").alias("added"),
    )


def unknown_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0")
    return e.select(F.lit("test:64").alias("namespace"), F.col("vec_id").alias("print_id"), F.floor(F.col("vec_id") / 10).alias("job_id"), F.concat(F.lit("SPEAKER_"), (F.col("vec_id") % 10).cast("string")).alias("speaker_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("job_id"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"), F.col("source").alias("dir"), "lang", F.col("doc_id").alias("mtime"),
        (F.col("doc_id") % 4 != 0).alias("transcribed"), F.length("text").cast("long").alias("size"),
    )


def live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as live lines of a recording for each user; p is a stand-in for a model's probability, in thousandths."""
    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("recording"), F.when(F.col("event_type").isin("click", "view"), "mic").otherwise("system").alias("track"), "event_id", "event_type",
        F.floor((micros - F.min(micros).over(own)) / 1000).alias("start_ms"), F.floor(1000 * F.col("value") / F.max("value").over(own)).cast("long").alias("p_milli"),
    )


def live_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of up to 11 words of live meetings, on the track of who speaks; seq is the time, which no two share."""
    t = conv_turns(spark, sf_dir).where("n_words > 0").select("job_id", "turn", "speaker", "n_words", F.col("start_ms").alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_words") - 1) / 11))).alias("k"))
    start = F.col("t") + 5200 * F.col("k")
    return t.select(
        F.col("job_id").alias("recording"), "turn", "k", F.when(F.col("speaker") == "user", "mic").otherwise("system").alias("track"), F.col("speaker").alias("voice"), start.alias("seq"),
        F.col("t").alias("turn_start"), start.alias("start_ms"), (start + 400 * F.least(F.lit(11), F.col("n_words") - 11 * F.col("k")) - 100).alias("end_ms"),
    )
