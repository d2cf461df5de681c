"""Queries of voices, rosters and table changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.operators import roster, samples, voices
from talkspark.operators.places import numbered_within, parts_for, stored
from talkspark.plans import views
from talkspark.plans.oracle_views import sql


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def matched(spark, sf):
    return voices.best_voice(views.unknown_prints(spark, sf), voices.centroids(views.voice_members(spark, sf)))


def a3(spark, sf):
    c = voices.centroids(views.voice_members(spark, sf))
    return c.select("name", F.posexplode("centroid").alias("place", "x")).withColumn("x", F.round("x", 6))


def j5(spark, sf):
    return rounded(matched(spark, sf).select("print_id", "name", "score"), "score")


def j6(spark, sf):
    return rounded(voices.resolved(matched(spark, sf), 0.3).select("print_id", "resolved", "score"), "score")


def j7(spark, sf):
    p = views.unknown_prints(spark, sf).withColumn("asked", F.concat(F.lit("voice_"), (F.col("print_id") % 12).cast("string")))
    return rounded(voices.similarity_to(p, voices.centroids(views.voice_members(spark, sf))).select("print_id", "asked", "similarity"), "similarity")


def new_members(spark, sf):
    """Prints of every tenth vector are taught anew as voice_0, twice for every twentieth; some blank names."""
    p = views.voice_members(spark, sf).where("added % 10 = 1")
    again = p.where("added % 20 = 1").withColumn("added", F.col("added") + 1000000)
    name = F.when(F.col("added") % 30 == 1, F.lit(" ")).otherwise(F.lit("voice_0"))
    return p.unionByName(again).withColumn("name", name)


def m2(spark, sf):
    return voices.folded(views.voice_members(spark, sf), new_members(spark, sf)).select("name", "job_id", "speaker_id", "added")


def m3(spark, sf):
    m = views.voice_members(spark, sf)
    return voices.unfolded(m, m.where("added % 3 = 0 OR name = 'voice_7'").select("namespace", "name", "job_id", "speaker_id")).groupBy("name").agg(F.count("*").alias("n"), F.max("added").alias("newest"))


def m4(spark, sf):
    return voices.renamed(views.voice_members(spark, sf), "voice_1", "voice_2", "test:64").where("name <> 'voice_9'").groupBy("name").agg(F.count("*").alias("n"), F.sum("added").alias("added"))


def m4_deleted(spark, sf):
    """Voices after one is deleted in a log and old folds of it come again; later ones count."""
    return voices.members_after(member_log(spark, sf)).groupBy("name").agg(F.count("*").alias("n"), F.sum("added").alias("added"))


def member_log(spark, sf):
    """Every member folded at its time, every ninth unfolded later, voice_3 and voice_4 deleted at 300, and a third of all folds again."""
    m = views.voice_members(spark, sf).withColumnRenamed("added", "seq")
    fold = m.withColumn("op", F.lit("fold"))
    unfold = m.where("seq % 9 = 0").withColumns({"op": F.lit("unfold"), "seq": F.col("seq") + 5})
    ends = m.where("name IN ('voice_3', 'voice_4')").select("namespace", "name").distinct().select(
        F.lit(300).cast("bigint").alias("seq"), F.lit("delete").alias("op"), "namespace", "name", F.lit(None).cast("bigint").alias("job_id"), F.lit(None).cast("string").alias("speaker_id"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("double").alias("weight")
    )
    return fold.unionByName(unfold).unionByName(fold.where("seq % 3 = 0")).unionByName(ends)


def m6(spark, sf):
    """Centroids after every seventh print lost its name, from the sums and what went."""
    members = views.voice_members(spark, sf)
    labels = members.select("job_id", F.col("speaker_id").alias("speaker"), F.col("name").alias("label"))
    who = labels.where("(job_id * 10 + cast(substring(speaker, 9) as int)) % 7 = 0").select("job_id", "speaker")
    left, taught = voices.unassigned(labels, members, who)
    made = voices.centroids_of(voices.changed_sums(voices.print_sums(members), taught)).select("name", F.posexplode("centroid").alias("place", "x"))
    counts = left.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n_labels"))
    return made.join(counts, "name").withColumn("x", F.round("x", 6))


def j6_threshold(spark, sf):
    """Prints of a part of each voice's members against the voices of all: the larger the part, the nearer; at the thresholds that hold by default."""
    m = views.voice_members(spark, sf)
    parts = m.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(9)))).where(F.pmod(F.floor("added").cast("bigint"), F.lit(10)) <= F.col("part"))
    asked = voices.centroids(parts.withColumn("name", F.concat_ws("/", "name", "part"))).select("namespace", F.col("name").alias("print_id"), F.col("centroid").alias("embedding"))
    near = voices.best_voice(asked, voices.centroids(m))
    own = F.element_at(F.split("print_id", "/"), 1)
    given = near.withColumn("given", F.when(F.element_at(F.split("print_id", "/"), 2).cast("int") % 2 == 0, own))
    out = voices.suggested(voices.resolved(given))
    return out.select("print_id", "resolved", "suggested", F.round("score", 6).alias("score"))


def j11(spark, sf):
    jobs = views.recordings(spark, sf).where("job_id % 3 <> 0")
    return voices.with_provenance(views.voice_members(spark, sf), jobs).select("name", "added", "source", "playable")


def a1(spark, sf):
    return roster.talk_time(views.big_turns(spark, sf))


def a2(spark, sf):
    return roster.speaker_counts(views.big_turns(spark, sf))


def roster_rows(spark, sf):
    """Roster of the jobs that prints belong to."""
    p = views.unknown_prints(spark, sf)
    t = p.select("job_id", F.lit(0).alias("turn_ix"), F.col("speaker_id").alias("speaker"), F.lit(0).alias("start_ms"), (1000 + 137 * (F.col("print_id") % 97)).alias("end_ms"))
    m = matched(spark, sf).select("job_id", F.col("speaker_id").alias("speaker"), "name", "score")
    labels = p.where("print_id % 3 = 0").select("job_id", F.col("speaker_id").alias("speaker"), F.when(F.col("print_id") % 2 == 0, F.concat(F.lit("Person "), (F.col("print_id") % 7).cast("string"))).otherwise(F.lit("  ")).alias("label"))
    gone = p.where("print_id % 11 = 0").select("job_id", F.col("speaker_id").alias("speaker"))
    return roster.roster(t, m, labels, gone, 0.3)


ROSTER = """labels AS (SELECT job_id, speaker_id AS speaker, CASE WHEN print_id % 2 = 0 THEN 'Person ' || (print_id % 7) END AS assigned FROM prints WHERE print_id % 3 = 0),
roster AS (SELECT m.job_id, m.speaker_id AS speaker, l.assigned, CASE WHEN m.score >= 0.3 THEN m.name END AS suggested, greatest(0.0, m.score) AS score, round((1000 + 137 * (m.print_id % 97)) / 1000, 1) AS talk_s, m.print_id % 11 = 0 AS excluded
  FROM matches m LEFT JOIN labels l ON m.job_id = l.job_id AND m.speaker_id = l.speaker)"""


def a5(spark, sf):
    return rounded(roster_rows(spark, sf), "score")


def a6(spark, sf):
    return roster.entries(roster_rows(spark, sf))


def a8(spark, sf):
    return roster.waiting(roster_rows(spark, sf)).withColumn("waiting", F.array_join("waiting", ","))


def a9(spark, sf):
    named = roster.current_labels(name_log(spark, sf)).withColumnRenamed("label", "assigned")
    return roster.split_people(named).select("job_id", "name", "n_speakers", F.array_join("speakers", ",").alias("speakers"))


def a10(spark, sf):
    return roster.accepted(roster_rows(spark, sf)).select("job_id", "speaker", "assigned")


def a11(spark, sf):
    p = views.unknown_prints(spark, sf)
    cut = p.withColumn("embedding", F.when(F.col("print_id") % 2 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return roster.width_mismatch(cut, 64)


def a7(spark, sf):
    t = views.conv_turns(spark, sf).select("job_id", "speaker", "start_ms", "end_ms")
    labels = views.conv_turns(spark, sf).where("turn % 2 = 0").select("job_id", "speaker", F.col("turn").alias("given"), F.concat(F.lit("N"), (F.col("turn") % 3).cast("string")).alias("label"))
    gone = t.where("job_id % 5 = 0 AND speaker = 'assistant'").select("job_id", "speaker").distinct()
    return roster.job_summary(t, labels, gone).withColumn("names", F.array_join("names", ","))


def j4(spark, sf):
    t = views.conv_turns(spark, sf).select("job_id", "turn", "speaker")
    labels = t.where("job_id % 2 = 0").select("job_id", "speaker").distinct().withColumn("label", F.concat(F.upper("speaker"), F.col("job_id").cast("string")))
    return roster.labelled(t, labels)


def j10(spark, sf):
    r = views.recordings(spark, sf)
    return roster.reused(r, r.select(F.col("job_id").alias("path"), "fingerprint"), True).select("path", "reused_job")


def name_log(spark, sf):
    """Decisions on names: an entry for each event; every tenth takes the name off."""
    e = views.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("P"), (F.col("event_id") % 13).cast("string")))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("speaker"), name.alias("name"))


def m5(spark, sf):
    return roster.current_labels(name_log(spark, sf))


def j18(spark, sf):
    maps = roster.current_labels(name_log(spark, sf)).groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "label")))).alias("labels"))
    out = voices.renamed_in_labels(maps, "P3", "P4")
    return out.select("job_id", F.explode("labels").alias("speaker", "label"))


def m7(spark, sf):
    return roster.toggled(name_log(spark, sf), ["job_id", "speaker"])


def m7_set(spark, sf):
    return roster.removal_state(name_log(spark, sf).withColumn("removed", F.col("seq") % 4 == 1))


def m11(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), (F.col("event_id") % 131 - 10).alias("percent"))
    return roster.current_status(e)


def m10(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 977).alias("path"), F.when(F.col("event_type") == "error", "done").when(F.col("event_type") == "click", "running").otherwise("waiting").alias("state"))
    return roster.deduplicated_queue(e)


def m9(spark, sf):
    """A preset for each customer; a third have one saved, half of these under a key of their own."""
    c = views.table(spark, sf, "customer")
    presets = c.select(F.col("c_name").alias("key"), F.concat(F.lit("preset "), "c_mktsegment").alias("text"))
    saved = c.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("*"))).alias("key"), F.lit("own").alias("text"))
    return roster.library(presets, saved)


def m1(spark, sf):
    t = views.turns(spark, sf)
    return voices.channels_united(t.where("turn_ix % 2 = 0"), t.where("turn_ix % 2 = 1"))


def a4(spark, sf):
    t = m1(spark, sf)
    e = views.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("job_id"), F.concat(F.element_at(F.array(*map(F.lit, ("L_user", "L_assistant", "L_system", "R_user", "R_assistant", "R_system"))), (F.col("vec_id") % 6 + 1).cast("int"))).alias("speaker"), "embedding")
    return voices.collapsed_channel(t, e, "L_")


def a4_turns(spark, sf):
    return a4(spark, sf)[0]


def a4_prints(spark, sf):
    return a4(spark, sf)[1].select("job_id", "speaker", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round("x", 6))


def w9(spark, sf):
    return samples.longest_turns(views.big_turns(spark, sf), 3, 2000, 12000).select("job_id", "speaker", "place", "turn_ix", "start_ms", "end_ms")


def w10(spark, sf):
    return samples.montage(views.big_turns(spark, sf)).select("job_id", "speaker", "take_no", "turn_ix", "start_ms", "end_ms")


def files(spark, sf):
    """Sample files of the speakers of orders: renamed, kept, unnamed, deleted, doubled and stray ones."""
    r = stored(views.big_turns(spark, sf).select("job_id", "speaker").distinct(), "speakers").withColumn("suggestion", F.concat(F.lower("speaker"), F.lit("_0.80")))
    kind = F.col("job_id") % 7
    name = F.when(kind == 0, "NAME-ME").when(kind == 1, F.col("suggestion")).when(kind == 2, "").otherwise("Ann")
    f = r.where("job_id % 7 <> 6").select("job_id", F.concat("speaker", F.lit("__"), name, F.lit(".mp3")).alias("file"))
    more = r.where("job_id % 7 = 5 AND speaker = 'SPEAKER_1'").select("job_id", F.lit("SPEAKER_1__Bob.mp3").alias("file"))
    stray = r.where("job_id % 7 = 4").select("job_id", F.lit("SPEAKER_9__X.mp3").alias("file")).distinct()
    return f.unionByName(more).unionByName(stray), r


def decisions(spark, sf):
    f, r = files(spark, sf)
    return roster.sample_decisions(f, r, parts_for(spark, r.count()))


def j16(spark, sf):
    return decisions(spark, sf)[0]


def j16_problems(spark, sf):
    return decisions(spark, sf)[1]


FILES = """r AS (SELECT DISTINCT job_id, speaker, lower(speaker) || '_0.80' AS suggestion FROM big_turns)"""


def j17(spark, sf):
    r = views.recordings(spark, sf)
    f = r.select("dir", F.concat("dir", F.lit("/"), F.col("job_id").cast("string"), F.when(F.col("job_id") % 9 == 0, ".txt").when(F.col("job_id") % 2 == 0, ".WAV").otherwise(".mp3")).alias("path"))
    done = f.where("path LIKE '%3.%'").select(F.col("path").alias("source_path"))
    return roster.directory_progress(done, f)


def o1(spark, sf):
    """Jobs newest first, numbered."""
    r = views.recordings(spark, sf).groupBy("dir").agg(F.max("mtime").alias("newest"), F.sum("size").alias("size"))
    return numbered_within(r, [], [F.desc("newest"), F.col("dir")], "place")


def o6(spark, sf):
    name = F.concat(F.when(F.col("job_id") % 13 == 0, ".").otherwise(""), F.col("job_id").cast("string"))
    r = views.recordings(spark, sf).select("dir", F.concat("dir", F.lit("/"), name).alias("path"), "size")
    return roster.smallest_first(r).select("dir", "path", "place")


def j20(spark, sf):
    """Live voices, a recording for every 50 vectors, matched each time that their print grows."""
    v = F.col("vec_id")
    e = views.table(spark, sf, "embeddings").select(F.lit("test:64").alias("namespace"), F.floor(v / 50).alias("recording"), F.concat(F.lit("W"), (v % 10).cast("string")).alias("voice"), F.floor(v % 50 / 10).alias("window_ix"), v.alias("print_id"), F.col("embedding").cast("array<double>").alias("embedding"), (3.0 + v % 17).alias("weight"))
    m = voices.best_voice(voices.growing_prints(e), voices.centroids(views.voice_members(spark, sf)))
    m = voices.suggested(m.withColumn("given", F.regexp_replace("voice", "W", "voice_")), 0.3)
    return m.select("recording", "voice", "window_ix", F.col("name").alias("match"), F.round(F.greatest("score", F.lit(0.0)), 4).alias("score"), "suggested")


def f14(spark, sf):
    from talkspark.functions.scalars import slug

    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), slug(F.concat(F.col("c_mktsegment"), F.lit(" & "), F.col("c_nationkey").cast("string"))).alias("slug"))
    return roster.unique_keys(c)


def o7(spark, sf):
    return roster.fuzzy(views.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")), "rig").select("p_partkey", "name", "span")


QUERIES = {
    "a3_voice_centroids": a3, "j5_best_voice": j5, "j6_resolved_prints": j6, "j7_similarity_to_voice": j7, "m2_folded_members": m2, "m3_unfolded_members": m3, "m4_merged_voices": m4, "m4_deleted_voices": m4_deleted, "m6_unassigned": m6, "j6_at_threshold": j6_threshold, "j11_member_provenance": j11, "a1_talk_time": a1, "a2_speaker_counts": a2,
    "a5_roster": a5, "a6_speaker_entries": a6, "a7_job_summary": a7, "a8_waiting_speakers": a8, "a9_split_people": a9, "a10_accepted_suggestions": a10, "a11_width_mismatch": a11, "j4_labels_applied": j4, "j10_reuse_by_fingerprint": j10, "m5_current_labels": m5,
    "j18_voice_renamed": j18, "m7_toggled_removals": m7, "m7_set_removals": m7_set, "m11_current_status": m11, "m10_queue": m10, "m9_persona_library": m9, "m1_channels_united": m1, "a4_collapsed_turns": a4_turns, "a4_collapsed_prints": a4_prints,
    "w9_longest_turns": w9, "w10_montage": w10, "j16_sample_decisions": j16, "j16_sample_problems": j16_problems, "j17_directory_progress": j17, "o1_newest_first": o1, "f14_unique_keys": f14, "o7_fuzzy_names": o7, "o6_smallest_first": o6, "j20_live_matches": j20,
}
DECISIONS = "dec AS (SELECT user_id AS job_id, event_id AS seq, event_type AS speaker, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'P' || (event_id % 13) END AS name FROM events), cur AS (SELECT job_id, speaker, nullif(trim(arg_max(name, seq)), '') AS label FROM dec GROUP BY ALL)"
ORACLES = {
    "a3_voice_centroids": sql("SELECT name, unnest(range(64))::INT AS place, round(unnest(centroid), 6) AS x FROM voices", "voices"),
    "j5_best_voice": sql("SELECT print_id, name, round(score, 6) AS score FROM matches", "matches"),
    "j6_resolved_prints": sql("SELECT print_id, CASE WHEN score >= 0.3 THEN name END AS resolved, round(score, 6) AS score FROM matches", "matches"),
    "j7_similarity_to_voice": sql("SELECT print_id, 'voice_' || (print_id % 12) AS asked, round(list_cosine_similarity(embedding, centroid), 6) AS similarity FROM prints LEFT JOIN voices ON name = 'voice_' || (print_id % 12)", "prints", "voices"),
    "m2_folded_members": sql(""", nw AS (SELECT job_id, speaker_id, CASE WHEN added % 30 = 1 THEN ' ' ELSE 'voice_0' END AS name, added FROM (SELECT job_id, speaker_id, added FROM members WHERE added % 10 = 1 UNION ALL SELECT job_id, speaker_id, added + 1000000 FROM members WHERE added % 20 = 1)),
l AS (SELECT name, job_id, speaker_id, max(added) AS added FROM nw WHERE trim(name) <> '' GROUP BY ALL)
SELECT name, job_id, speaker_id, added FROM members m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.name = m.name AND l.job_id = m.job_id AND l.speaker_id = m.speaker_id) UNION ALL SELECT * FROM l""", "members").replace("\n, nw AS", ",\nnw AS"),
    "m3_unfolded_members": sql("SELECT name, count(*) AS n, max(added) AS newest FROM members WHERE NOT (added % 3 = 0 OR name = 'voice_7') GROUP BY name", "members"),
    "m4_merged_voices": sql("SELECT CASE WHEN name = 'voice_1' THEN 'voice_2' ELSE name END AS name, count(*) AS n, sum(added)::BIGINT AS added FROM members WHERE name <> 'voice_9' GROUP BY ALL", "members"),
    "m4_deleted_voices": sql(", f AS (SELECT name, added FROM members WHERE added % 9 <> 0 AND (name NOT IN ('voice_3', 'voice_4') OR added > 300)) SELECT name, count(*) AS n, sum(added)::BIGINT AS added FROM f GROUP BY name", "members").replace("\n, f AS", ",\nf AS"),
    "m6_unassigned": sql("SELECT name, unnest(range(64))::INT AS place, round(unnest(centroid), 6) AS x, n_labels FROM voices JOIN (SELECT name, count(*) AS n_labels FROM members GROUP BY name) USING (name)", "voices").replace("WHERE vec_id % 5 <> 0)", "WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0)"),
    "j6_at_threshold": sql(""", pm AS (SELECT name || '/' || part AS print_id, name AS own, part, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM members, (SELECT unnest(range(1, 10)) AS part) WHERE added % 10 <= part),
pd AS (SELECT print_id, own, part, unnest(e) AS x, unnest(range(len(e))) AS d FROM pm), pv AS (SELECT print_id, own, part, list(x ORDER BY d) AS v FROM (SELECT print_id, own, part, d, sum(x) AS x FROM pd GROUP BY ALL) GROUP BY ALL),
px AS (SELECT print_id, own, part, name, list_cosine_similarity(v, centroid) AS score FROM pv, voices QUALIFY row_number() OVER (PARTITION BY print_id ORDER BY score DESC, name) = 1)
SELECT print_id, CASE WHEN score >= 0.75 THEN name END AS resolved, CASE WHEN score >= 0.75 AND (part % 2 = 1 OR name <> own) THEN name END AS suggested, round(score, 6) AS score FROM px""", "voices").replace("\n, pm AS", ",\npm AS"),
    "j11_member_provenance": sql("SELECT name, added, dir AS source, r.job_id IS NOT NULL AS playable FROM members m LEFT JOIN (SELECT * FROM recordings WHERE job_id % 3 <> 0) r USING (job_id)", "members", "recordings"),
    "a1_talk_time": sql("SELECT job_id, speaker, sum(greatest(0, end_ms - start_ms))::BIGINT AS talk_ms FROM big_turns GROUP BY ALL", "big_turns"),
    "a2_speaker_counts": sql("SELECT job_id, count(DISTINCT speaker) AS n_speakers FROM big_turns GROUP BY ALL", "big_turns"),
    "a5_roster": sql(", " + ROSTER + " SELECT job_id, speaker, assigned, suggested, round(score, 6) AS score, talk_s, excluded FROM roster", "matches").replace("\n, labels", ",\nlabels"),
    "a6_speaker_entries": sql(", " + ROSTER + " SELECT job_id, speaker, coalesce(assigned, suggested) AS label, CASE WHEN assigned IS NOT NULL THEN 'named' WHEN suggested IS NOT NULL THEN 'suggestion' END AS label_source FROM roster", "matches").replace("\n, labels", ",\nlabels"),
    "a7_job_summary": sql("""SELECT t.job_id, max(end_ms) AS duration_ms, count(DISTINCT speaker) AS n_speakers, coalesce(any_value(n.names), '') AS names FROM conv_turns t LEFT JOIN
 (SELECT job_id, string_agg(label, ',' ORDER BY g) AS names FROM (SELECT job_id, 'N' || (turn % 3) AS label, min(turn) AS g FROM conv_turns WHERE turn % 2 = 0 AND NOT (job_id % 5 = 0 AND speaker = 'assistant') GROUP BY ALL) GROUP BY job_id) n ON t.job_id = n.job_id GROUP BY t.job_id""", "conv_turns"),
    "a8_waiting_speakers": sql(", " + ROSTER + " SELECT job_id, string_agg(speaker, ',' ORDER BY speaker) AS waiting FROM roster WHERE assigned IS NULL AND NOT excluded GROUP BY job_id", "matches").replace("\n, labels", ",\nlabels"),
    "a9_split_people": f"WITH {DECISIONS} SELECT job_id, label AS name, count(*) AS n_speakers, string_agg(speaker, ',' ORDER BY speaker) AS speakers FROM cur WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "a10_accepted_suggestions": sql(", " + ROSTER + " SELECT job_id, speaker, coalesce(assigned, CASE WHEN NOT excluded THEN suggested END) AS assigned FROM roster", "matches").replace("\n, labels", ",\nlabels"),
    "a11_width_mismatch": sql("SELECT job_id, CASE WHEN bool_and(print_id % 2 = 0) THEN 32 END::INT AS mismatch FROM prints GROUP BY job_id", "prints"),
    "j4_labels_applied": sql("SELECT job_id, turn, speaker, CASE WHEN job_id % 2 = 0 THEN upper(speaker) || job_id END AS resolved_label FROM conv_turns", "conv_turns"),
    "j10_reuse_by_fingerprint": sql("SELECT a.job_id AS path, b.j AS reused_job FROM recordings a LEFT JOIN (SELECT fingerprint, arg_max(job_id, mtime) AS j FROM recordings WHERE transcribed GROUP BY fingerprint) b USING (fingerprint)", "recordings"),
    "m5_current_labels": f"WITH {DECISIONS} SELECT * FROM cur WHERE label IS NOT NULL",
    "j18_voice_renamed": f"WITH {DECISIONS} SELECT job_id, speaker, CASE WHEN label = 'P3' THEN 'P4' ELSE label END AS label FROM cur WHERE label IS NOT NULL AND job_id IN (SELECT job_id FROM cur WHERE label = 'P3')",
    "m7_toggled_removals": f"WITH {DECISIONS} SELECT job_id, speaker FROM dec GROUP BY ALL HAVING count(*) % 2 = 1",
    "m7_set_removals": f"WITH {DECISIONS} SELECT job_id, speaker FROM dec GROUP BY ALL HAVING max(seq) % 4 = 1",
    "m11_current_status": """SELECT job_id, status, CASE WHEN status = 'running' THEN greatest(1, p) ELSE p END AS percent FROM (SELECT user_id AS job_id, arg_max(CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'running' END, event_id) AS status,
 greatest(0, least(100, arg_max(event_id % 131 - 10, event_id))) AS p FROM events GROUP BY user_id)""",
    "m10_queue": """SELECT path, seq, CASE WHEN s = 'running' THEN 'waiting' ELSE s END AS state FROM (SELECT event_id % 977 AS path, max(event_id) AS seq, arg_max(CASE WHEN event_type = 'error' THEN 'done' WHEN event_type = 'click' THEN 'running' ELSE 'waiting' END, event_id) AS s FROM events GROUP BY ALL) WHERE s <> 'done'""",
    "m9_persona_library": """SELECT coalesce(s.key, c_name) AS key, coalesce(s.text, 'preset ' || c_mktsegment) AS text, s.text IS NOT NULL AS is_saved FROM customer FULL JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '*' END AS key, 'own' AS text FROM customer WHERE c_custkey % 3 = 0) s ON c_name = s.key""",
    "m1_channels_united": sql("SELECT job_id, turn_ix, CASE WHEN turn_ix % 2 = 0 THEN 'L_' ELSE 'R_' END || speaker AS speaker, start_ms, end_ms FROM turns", "turns"),
    "a4_collapsed_turns": sql("""SELECT job_id, turn_ix, CASE WHEN turn_ix % 2 = 0 THEN min(CASE WHEN turn_ix % 2 = 0 THEN 'L_' || speaker END) OVER (PARTITION BY job_id) ELSE 'R_' || speaker END AS speaker, start_ms, end_ms FROM turns""", "turns"),
    "a4_collapsed_prints": sql(""", e AS (SELECT vec_id // 6 AS job_id, ['L_user', 'L_assistant', 'L_system', 'R_user', 'R_assistant', 'R_system'][vec_id % 6 + 1] AS speaker, embedding FROM embeddings),
talk AS (SELECT job_id, 'L_' || speaker AS speaker, sum(end_ms - start_ms) AS talk FROM turns WHERE turn_ix % 2 = 0 GROUP BY ALL), least1 AS (SELECT job_id, min(speaker) AS t FROM talk GROUP BY job_id),
own AS (SELECT e.job_id, l.t AS speaker, embedding, talk, sum(talk) OVER (PARTITION BY e.job_id) AS total FROM e JOIN least1 l ON e.job_id = l.job_id LEFT JOIN talk ON e.job_id = talk.job_id AND e.speaker = talk.speaker WHERE e.speaker LIKE 'L\\_%' ESCAPE '\\'),
c AS (SELECT job_id, speaker, CASE WHEN coalesce(total, 0) > 0 THEN coalesce(talk, 0)::DOUBLE ELSE 1.0 END AS w, unnest(range(64)) AS place, unnest(embedding)::DOUBLE AS x FROM own)
SELECT job_id, speaker, place::INT AS place, round(sum(w * x) / sum(w), 6) AS x FROM c GROUP BY job_id, speaker, place
UNION ALL SELECT job_id, speaker, place::INT, round(x, 6) FROM (SELECT job_id, speaker, unnest(range(64)) AS place, unnest(embedding)::DOUBLE AS x FROM e WHERE speaker LIKE 'R\\_%' ESCAPE '\\')""", "turns").replace("\n, e AS", ",\ne AS"),
    "w9_longest_turns": sql("SELECT job_id, speaker, place, turn_ix, start_ms, least(end_ms, start_ms + 12000) AS end_ms FROM (SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY end_ms - start_ms DESC, turn_ix) AS place FROM big_turns) WHERE place <= 3 AND end_ms - start_ms >= 2000", "big_turns"),
    "w10_montage": sql(""", a AS (SELECT *, row_number() OVER o AS place, least(end_ms - start_ms, 10000) AS take FROM big_turns WINDOW o AS (PARTITION BY job_id, speaker ORDER BY end_ms - start_ms DESC, turn_ix)),
b AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY job_id, speaker ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM a)
SELECT job_id, speaker, row_number() OVER (PARTITION BY job_id, speaker ORDER BY start_ms, turn_ix) AS take_no, turn_ix, start_ms, start_ms + take AS end_ms FROM b WHERE NOT (bef >= 8000 AND (place > 3 OR take < 1500))""", "big_turns").replace("\n, a AS", ",\na AS"),
    "j16_sample_decisions": sql(", " + FILES + """ SELECT job_id, speaker, CASE job_id % 7 WHEN 0 THEN 'unnamed' WHEN 1 THEN 'suggestion' WHEN 6 THEN 'dropped' ELSE 'named' END AS decision, CASE job_id % 7 WHEN 0 THEN NULL WHEN 1 THEN suggestion WHEN 6 THEN NULL ELSE 'Ann' END AS name
 FROM r WHERE job_id % 7 <> 2 AND NOT (job_id % 7 = 5 AND speaker = 'SPEAKER_1')""", "big_turns").replace("\n, r AS", ",\nr AS"),
    "j16_sample_problems": sql(", " + FILES + """ SELECT job_id, speaker || '__.mp3' AS file, 'no name' AS problem FROM r WHERE job_id % 7 = 2 UNION ALL SELECT DISTINCT job_id, 'SPEAKER_9__X.mp3', 'no such speaker' FROM r WHERE job_id % 7 = 4
 UNION ALL SELECT job_id, unnest(['SPEAKER_1__Ann.mp3', 'SPEAKER_1__Bob.mp3']), 'several files of one speaker' FROM r WHERE job_id % 7 = 5 AND speaker = 'SPEAKER_1'""", "big_turns").replace("\n, r AS", ",\nr AS"),
    "j17_directory_progress": sql(", f AS (SELECT dir, dir || '/' || job_id || CASE WHEN job_id % 9 = 0 THEN '.txt' WHEN job_id % 2 = 0 THEN '.WAV' ELSE '.mp3' END AS path FROM recordings) SELECT dir, count(*) FILTER (WHERE path LIKE '%3.%') AS done, count(*) AS total FROM f WHERE path NOT LIKE '%.txt' GROUP BY dir", "recordings").replace("\n, f AS", ",\nf AS"),
    "o1_newest_first": sql("SELECT dir, max(mtime) AS newest, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY max(mtime) DESC, dir) AS place FROM recordings GROUP BY dir", "recordings"),
    "f14_unique_keys": "SELECT seq, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS key FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq) AS n FROM (SELECT c_custkey AS seq, regexp_replace(lower(c_mktsegment || ' & ' || c_nationkey), '[^a-z0-9]+', '-', 'g') AS slug FROM customer))",
    "o6_smallest_first": sql("SELECT dir, dir || '/' || job_id AS path, row_number() OVER (PARTITION BY dir ORDER BY size, dir || '/' || job_id) AS place FROM recordings WHERE job_id % 13 <> 0", "recordings"),
    "j20_live_matches": sql(""", gw AS (SELECT vec_id, vec_id // 50 AS recording, vec_id % 10 AS v, vec_id % 50 // 10 AS window_ix, 3.0 + vec_id % 17 AS w, embedding::DOUBLE[] AS e FROM embeddings),
gx AS (SELECT vec_id, recording, v, window_ix, w / sqrt(list_dot_product(e, e)) AS w, unnest(e) AS x, unnest(range(len(e))) AS d FROM gw),
gs AS (SELECT vec_id, recording, v, window_ix, d, sum(x * w) OVER (PARTITION BY recording, v, d ORDER BY window_ix, vec_id) AS x FROM gx),
gp AS (SELECT vec_id, recording, v, window_ix, list(x ORDER BY d) AS p FROM gs GROUP BY vec_id, recording, v, window_ix),
gm AS (SELECT gp.*, name, list_cosine_similarity(p, centroid) AS score FROM gp, voices)
SELECT recording, 'W' || v AS voice, window_ix, name AS match, round(greatest(score, 0.0), 4) AS score, CASE WHEN score >= 0.3 AND name <> 'voice_' || v THEN name END AS suggested
 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS rn FROM gm) WHERE rn = 1""", "voices").replace("\n, gw AS", ",\ngw AS"),
    "o7_fuzzy_names": "SELECT p_partkey, p_name AS name, length(regexp_extract(p_name, '(?i)r.*?i.*?g'))::INT AS span FROM part WHERE regexp_matches(p_name, '(?i)r.*?i.*?g')",
}
