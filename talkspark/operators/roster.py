"""Rosters of jobs: talk time, names, removals, reuse, status, and changes to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.functions.scalars import blank_to_null
from talkspark.operators import live
from talkspark.operators.places import dealt, numbered_within, spread_join, stored
from talkspark.operators.voices import THRESHOLD


def talk_time(turns: DataFrame) -> DataFrame:
    return turns.groupBy("job_id", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("talk_ms"))


def speaker_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("job_id").agg(F.countDistinct("speaker").alias("n_speakers"))


def roster(turns: DataFrame, matches: DataFrame, labels: DataFrame, excluded: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each speaker of each job: assigned, suggested, score (0 at least), talk_s (one decimal), excluded.

    matches: job_id, speaker, name, score. labels: job_id, speaker, label. excluded: job_id, speaker.
    """
    m = matches.select("job_id", "speaker", F.col("name").alias("m_name"), F.col("score").alias("m_score"))
    l = labels.select("job_id", "speaker", blank_to_null(F.col("label")).alias("assigned"))  # noqa: E741
    e = excluded.select("job_id", "speaker").distinct().withColumn("gone", F.lit(True))
    out = talk_time(turns).join(m, ["job_id", "speaker"], "left").join(l, ["job_id", "speaker"], "left").join(e, ["job_id", "speaker"], "left")
    return out.select(
        "job_id", "speaker", "assigned", F.when(F.col("m_score") >= threshold, F.col("m_name")).alias("suggested"), F.greatest(F.lit(0.0), F.coalesce("m_score", F.lit(0.0))).alias("score"),
        F.round(F.col("talk_ms") / 1000, 1).alias("talk_s"), F.coalesce("gone", F.lit(False)).alias("excluded"),
    )


def entries(rows: DataFrame) -> DataFrame:
    """Roster rows with label and where it is from: named, suggestion or neither."""
    return rows.select("job_id", "speaker", F.coalesce("assigned", "suggested").alias("label"), F.when(F.col("assigned").isNotNull(), "named").when(F.col("suggested").isNotNull(), "suggestion").alias("label_source"))


def waiting(rows: DataFrame) -> DataFrame:
    """Speakers of each job that have no name and aren't removed."""
    w = rows.where("assigned is null AND NOT excluded")
    return w.groupBy("job_id").agg(F.array_sort(F.collect_list("speaker")).alias("waiting"))


def split_people(rows: DataFrame) -> DataFrame:
    """Names that stand on several speakers of one job."""
    return rows.where("assigned is not null").groupBy("job_id", F.col("assigned").alias("name")).agg(F.count("*").alias("n_speakers"), F.array_sort(F.collect_list("speaker")).alias("speakers")).where("n_speakers > 1")


def accepted(rows: DataFrame) -> DataFrame:
    """Roster with suggestions taken as names, for speakers that have none and aren't removed."""
    return rows.withColumn("assigned", F.coalesce("assigned", F.when(~F.col("excluded"), F.col("suggested"))))


def job_summary(turns: DataFrame, labels: DataFrame, excluded: DataFrame) -> DataFrame:
    """Duration, speakers, and names in the order in which they were given (labels.given), without removed ones."""
    base = turns.groupBy("job_id").agg(F.max("end_ms").alias("duration_ms"), F.countDistinct("speaker").alias("n_speakers"))
    named = labels.where(blank_to_null(F.col("label")).isNotNull()).join(excluded, ["job_id", "speaker"], "left_anti")
    names = named.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("given", "label"))).alias("l")).select("job_id", F.array_distinct("l.label").alias("names"))
    return base.join(names, "job_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def width_mismatch(prints: DataFrame, width: int) -> DataFrame:
    """Smallest width of a job's prints, where the namespace's width isn't among them; else null."""
    w = prints.groupBy("job_id").agg(F.collect_set(F.size("embedding")).alias("w"))
    return w.select("job_id", F.when(~F.array_contains("w", width), F.array_min("w")).alias("mismatch"))


def reused(jobs: DataFrame, new: DataFrame, require_transcribed: bool = False) -> DataFrame:
    """new (path, fingerprint) with the newest job of the same content, null where there is none."""
    fit = jobs.where("transcribed") if require_transcribed else jobs
    newest = fit.groupBy("fingerprint").agg(F.max(F.struct("mtime", "job_id")).alias("j")).select("fingerprint", F.col("j.job_id").alias("reused_job"))
    return new.join(newest, "fingerprint", "left")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with resolved_label: the label given to their speaker."""
    return rows.join(labels.select("job_id", "speaker", F.col("label").alias("resolved_label")), ["job_id", "speaker"], "left")


def current_labels(log: DataFrame) -> DataFrame:
    """Label maps after a log of decisions (job_id, seq, speaker, name): the last counts, a blank name takes it off."""
    last = log.groupBy("job_id", "speaker").agg(F.max_by("name", "seq").alias("name"))
    return last.select("job_id", "speaker", blank_to_null(F.col("name")).alias("label")).where("label is not null")


def toggled(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a log toggled an odd number of times."""
    return log.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def removal_state(log: DataFrame) -> DataFrame:
    """(job_id, speaker) set as removed by the last entry of a log (job_id, seq, speaker, removed)."""
    return log.groupBy("job_id", "speaker").agg(F.max_by("removed", "seq").alias("removed")).where("removed").select("job_id", "speaker")


def current_status(events: DataFrame) -> DataFrame:
    """The latest event of each job; percent within 0..100, and 1 at least while running."""
    last = events.groupBy("job_id").agg(F.max(F.struct("seq", "status", "percent")).alias("e"))
    p = F.greatest(F.lit(0), F.least(F.lit(100), F.col("e.percent")))
    return last.select("job_id", F.col("e.status").alias("status"), F.when(F.col("e.status") == "running", F.greatest(F.lit(1), p)).otherwise(p).alias("percent"))


def sample_decisions(files: DataFrame, rows: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What the names of sample files decide about speakers: (job_id, speaker, decision, name), and problems.

    A file `<speaker>__<name>.<ext>` belongs to the speaker with the longest matching ID. No file: dropped; name
    NAME-ME: unnamed; the suggestion as written: suggestion; else named. Problems: no such speaker, no name, two
    files of one speaker. parts: as of dealt().
    """
    file, who = ["job_id", "file"], ["job_id", "speaker"]
    f = files.select("job_id", "file", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"))
    r = rows.select("job_id", "speaker", "suggestion")
    hits = dealt(f, parts, "job_id").join(dealt(r, parts, "job_id"), "job_id").where(F.col("stem").startswith(F.concat("speaker", F.lit("__"))))
    best = hits.groupBy("job_id", "file", "stem").agg(F.max(F.struct(F.length("speaker").alias("n"), "speaker", "suggestion")).alias("b"))
    best = best.select("job_id", "file", "b.speaker", "b.suggestion", F.trim(F.substring("stem", F.length("b.speaker") + 3, F.length("stem"))).alias("name"))
    per = best.groupBy("job_id", "speaker").agg(F.count("*").alias("n_files"), F.min("name").alias("name"))
    out = dealt(r, parts, *who).join(dealt(per, parts, *who), who, "left")
    decision = F.when(F.col("n_files").isNull(), "dropped").when(F.col("name") == "NAME-ME", "unnamed").when(F.col("name") == F.col("suggestion"), "suggestion").otherwise("named")
    decided = out.where("n_files is null OR (n_files = 1 AND name <> '')").select("job_id", "speaker", decision.alias("decision"), F.when(decision.isin("named", "suggestion"), F.col("name")).alias("name"))
    unknown = dealt(f, parts, *file).join(dealt(best.select(*file), parts, *file), file, "left_anti").select("job_id", "file", F.lit("no such speaker").alias("problem"))
    empty = best.where("name = ''").select("job_id", "file", F.lit("no name").alias("problem"))
    twice = dealt(best, parts, *who).join(dealt(per.where("n_files > 1"), parts, *who), who, "left_semi").select("job_id", "file", F.lit("several files of one speaker").alias("problem"))
    return decided, unknown.unionByName(empty).unionByName(twice)


def directory_progress(jobs: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("wav", "mp3", "m4a", "flac", "ogg", "opus")) -> DataFrame:
    """Recordings of each folder and how many have a job; other files than audio don't count. files: dir, path."""
    audio = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*suffixes))
    done = jobs.select(F.col("source_path").alias("path")).distinct().withColumn("done", F.lit(True))
    return audio.join(done, "path", "left").groupBy("dir").agg(F.count_if(F.coalesce("done", F.lit(False))).alias("done"), F.count("*").alias("total"))


def smallest_first(files: DataFrame) -> DataFrame:
    """files (dir, path, size) with their place in the order of labelling: smallest first within a folder, hidden ones left out."""
    shown = files.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    return numbered_within(shown, ["dir"], [F.col("size"), F.col("path")], "place")


def deduplicated_queue(rows: DataFrame) -> DataFrame:
    """A queue (seq, path, state) with the later row of each path; running counts as waiting again, done goes."""
    last = rows.groupBy("path").agg(F.max(F.struct("seq", "state")).alias("r")).select("path", "r.seq", "r.state")
    return last.where("state <> 'done'").withColumn("state", F.when(F.col("state") == "running", "waiting").otherwise(F.col("state")))


def library(presets: DataFrame, saved: DataFrame) -> DataFrame:
    """Presets (key, text) with saved ones over them."""
    p, s = presets.toDF("key", "preset"), saved.toDF("key", "own")
    return p.join(s, "key", "full_outer").select("key", F.coalesce("own", "preset").alias("text"), F.col("own").isNotNull().alias("is_saved"))


#: Numbers at the end of a slug that may make it look like a numbered key of a shorter one: a slug has 40 characters.
DEPTH = 20


def unique_keys(names: DataFrame) -> DataFrame:
    """names (seq, slug) with key: in order of seq the slug, or with the first of -2, -3, ... that makes a free key.

    An empty slug is "persona". A key belongs to the slug of the same name, whose first row wants it, or to the numbered rows of the
    slug that is left without its last number; whoever is earlier has it. The r-th row of a slug would have number r; it moves
    on by one for each number below that was gone to such a longer slug before. How many rows of a slug are earlier than a longer
    slug's first one decides that, so slugs are settled from the shortest chain of numbers to the longest, each from
    counts; no task reads all rows of a slug (see numbered_within), only one row for each longer slug.
    """
    base = F.when(F.coalesce("slug", F.lit("")) == "", "persona").otherwise(F.col("slug"))
    rows = stored(numbered_within(names.select("seq", "slug", base.alias("base")), ["base"], [F.col("seq")], "rank"), "ranked")
    slugs = rows.groupBy("base").agg(F.min("seq").alias("first"))
    # the slug that a slug may be a numbered key of, and the number: from 2 on, as written
    split = slugs.select("base", "first", F.regexp_extract("base", r"^(.+)-([1-9][0-9]{0,8})$", 1).alias("parent"), F.regexp_extract("base", r"^(.+)-([1-9][0-9]{0,8})$", 2).alias("digits"))
    longer = split.where("parent <> '' AND digits <> '1'").withColumn("number", F.col("digits").cast("long"))
    longer = longer.join(slugs.select(F.col("base").alias("parent")), "parent").select("parent", "base", "number", "first")
    # rows of the parent before the longer slug's first row: those of its own rank tell, as of that time
    marks = rows.select(F.col("base").alias("parent"), "seq", "rank", F.lit(None).cast("string").alias("base"), F.lit(None).cast("long").alias("number")).join(longer.select("parent").distinct(), "parent", "left_semi")
    asked = longer.select("parent", F.col("first").alias("seq"), F.lit(None).cast("bigint").alias("rank"), "base", "number")
    both = stored(numbered_within(marks.unionByName(asked), ["parent"], [F.col("seq"), F.col("base").asc_nulls_first()], "place"), "marks")
    asks = numbered_within(both.where("base is not null"), ["parent"], [F.col("seq")], "nth").withColumn("earlier", F.col("place") - F.col("nth"))
    asks = stored(asks.select("parent", "base", "number", "earlier"), "asks")
    # level by level: lost (0 or 1) says whether a slug's own name is gone
    lost = slugs.join(longer.select("base"), "base", "left_anti").select("base", F.lit(0).alias("lost"))
    settled, gone = lost, None
    for _ in range(DEPTH):
        children = asks.join(lost.select(F.col("base").alias("parent"), "lost"), "parent")

        def each(key: tuple, group):
            skipped = 0
            for parent, child, number, earlier, own in group:
                at = number - own - skipped  # the rank that would take this number
                held = earlier < at
                yield parent, child, at, 0 if held else 1
                skipped += held

        made = stored(live.over_groups(children, ["parent"], [F.col("number")], each, "parent string, base string, at bigint, lost int"), "settled")
        if made.isEmpty():
            break
        lost = made.select("base", "lost")
        settled = settled.unionByName(lost)
        held = made.where("lost = 0").groupBy(F.col("parent").alias("base")).agg(F.sort_array(F.collect_list("at")).alias("steps"))
        gone = held if gone is None else gone.unionByName(held)
    facts = settled if gone is None else settled.join(gone, "base", "left")
    steps = F.lit(0) if gone is None else F.coalesce(F.size(F.filter("steps", lambda t: t <= F.col("rank"))), F.lit(0))
    number = F.col("rank") + F.col("lost") + F.when(F.col("__any"), steps).otherwise(F.lit(0))
    facts = facts.withColumn("__any", F.lit(False) if gone is None else F.col("steps").isNotNull())
    out = spread_join(rows, facts, "base")
    return out.select("seq", "slug", F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), number.cast("string"))).alias("key"))


def fuzzy(names: DataFrame, query: str) -> DataFrame:
    """Names that hold the letters of the query in order, whatever the case; strength: the tightest match first."""
    import re

    pattern = "(?i)" + ".*?".join(re.escape(c) for c in query)
    hit = names.where(F.col("name").rlike(pattern))
    span = F.length(F.regexp_extract("name", pattern, 0))
    return hit.withColumns({"span": span, "at": F.instr(F.lower("name"), query[:1].lower())})
