"""Queries of live meetings, chunk plans and model scoring, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkspark import evals
from talkspark.operators import chunks, live, steps
from talkspark.plans import views
from talkspark.plans.oracle_views import sql


def spans(spark, sf):
    return views.conv_turns(spark, sf).groupBy("job_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def w6(spark, sf):
    return chunks.fixed_chunks(spans(spark, sf))


def w7(spark, sf):
    return chunks.turn_chunks(views.turns(spark, sf), spans(spark, sf).select("job_id", F.col("end_ms").alias("duration_ms")))


def f22(spark, sf):
    """The first 300 s of each job's turns, with the full duration."""
    from talkspark.functions.scalars import probe_end

    t = views.turns(spark, sf).withColumn("duration_ms", F.max("end_ms").over(Window.partitionBy("job_id")))
    return t.where("start_ms < 300000").select("job_id", "turn_ix", "start_ms", probe_end(F.col("end_ms")).alias("end_ms"), "duration_ms")


def covered_lines(spark, sf):
    """Live lines with what their track covers after them: 200 ms past the line."""
    l = views.live_lines(spark, sf)  # noqa: E741
    return l.select("recording", "track", F.col("event_id").alias("seq"), "start_ms", (F.col("start_ms") + 300).alias("end_ms"), (F.col("start_ms") + 500).alias("covered_ms"))


def t1(spark, sf):
    return live.released(covered_lines(spark, sf)).select("recording", "track", "seq", "released_at")


def o3(spark, sf):
    return live.release_order(live.released(covered_lines(spark, sf))).select("recording", "track", "seq", "place")


def w11(spark, sf):
    p = covered_lines(spark, sf).select("recording", "track", "seq", (F.col("start_ms") / 1000).cast("long").alias("start_ms"), ((F.col("start_ms") / 1000).cast("long") + 3600).alias("end_ms"))
    return live.rolling_window(p, 60_000, 7200).select("recording", "track", "seq", "stretch", "n_window", "window_start")


def j12(spark, sf):
    marks = views.conv_turns(spark, sf).select(F.col("job_id").alias("recording"), F.col("turn").alias("mark"), (F.col("start_ms") + 200).alias("at_ms"))
    return live.marked_voices(marks, views.turns(spark, sf).withColumnRenamed("job_id", "recording")).select("recording", "mark", "speaker")


def j13(spark, sf):
    l = views.live_lines(spark, sf).withColumn("speaker", F.when(F.col("event_id") % 4 == 0, F.col("event_type")))  # noqa: E741
    return live.last_known(l.select("recording", "track", "event_id", "speaker"), "speaker", ["recording", "track"], ["event_id"])


def a13(spark, sf):
    t = views.turns(spark, sf).select(F.col("job_id").alias("recording"), F.floor(F.col("turn_ix") / 2).alias("window_ix"), "speaker", "start_ms", "end_ms", (F.col("start_ms") + 2000 * (F.col("turn_ix") % 3)).alias("fresh_from"))
    return live.fresh_talk(t)


def w13(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("time"), "event_id")
    return live.numbered_events(e).select("session", "event_id", F.col("seq").cast("long").alias("seq"))


def w14(spark, sf):
    b = views.conv_turns(spark, sf).select(F.col("job_id").alias("session"), F.col("turn").alias("seq"), "text")
    return live.context_tail(b, 2000).select("session", "seq", "cut")


def j15(spark, sf):
    t = views.conv_turns(spark, sf)
    part = lambda df, at, text: df.select(F.col("job_id").alias("recording"), at.alias("at_ms"), text.alias("text"))
    rows = live.timeline(
        part(t, F.col("start_ms"), F.col("text")), part(t.where("turn % 3 = 0"), F.col("start_ms"), F.concat(F.lit("# part "), F.col("turn").cast("string"))), part(t.where("turn % 2 = 1"), F.col("start_ms"), F.concat(F.lit("> on "), F.col("turn").cast("string")))
    )
    return rows.select("recording", "at_ms", "rank", "text", "place")


def t8(spark, sf):
    l = views.live_lines(spark, sf).withColumns({"p_decision": F.when(F.col("event_type") == "purchase", F.col("p_milli")).otherwise(0), "p_todo": F.when(F.col("event_type") == "click", F.col("p_milli")).otherwise(0)})  # noqa: E741
    return live.gates(l, F.col("recording") % 5 == 0).select("recording", "event_id", "comment", "items")


def t9(spark, sf):
    l = views.live_lines(spark, sf)  # noqa: E741
    s = F.floor(F.col("start_ms") / 86_400_000)
    b = l.where("event_type = 'view'").select("recording", s.alias("section"), F.col("event_id").alias("batch"), F.col("start_ms").alias("until_ms"))
    return live.already_said(b, l.where("event_type = 'click'").select("recording", s.alias("section"), F.col("start_ms").alias("at_ms"), F.col("event_id").alias("comment_id")))


def t10(spark, sf):
    return live.due_times(covered_lines(spark, sf), 4.0).select("recording", "seq", "due_ms")


def live_runs(spark, sf, reach, name, after):
    l = views.live_lines(spark, sf).withColumn("end_ms", F.col("start_ms") + 3000)  # noqa: E741
    slim = l.select("recording", "event_id", "start_ms", "end_ms", "p_milli")
    return steps.runs(slim, ["recording"], ["start_ms", "event_id"], reach, name, after)


def t2(spark, sf):
    return live_runs(spark, sf, 30_000_000, "batch", True)


def t7(spark, sf):
    """Sections of step batches: the model's answers are stand-ins, from the first line's probability and number."""
    b = t2(spark, sf)
    first = b.groupBy("recording", "batch").agg(F.min(F.struct("start_ms", "event_id", "p_milli")).alias("f"), F.count("*").alias("n"))
    answers = first.select("recording", "batch", "f.p_milli", (F.col("f.event_id") % F.col("n")).alias("first_new"))
    return live.sections(b.select("recording", "batch", "start_ms", "end_ms", "event_id", "p_milli"), answers, 900_000_000, 60_000_000, 600)[0]


def t4(spark, sf):
    # longer than 100,000,000: a millisecond more at least
    return live_runs(spark, sf, 100_000_001, "piece", False)


def t5(spark, sf):
    """Voices of a recording for every 50 vectors, ten to a window."""
    e = views.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), F.floor(F.col("vec_id") % 50 / 10).alias("window_ix"), F.concat(F.lit("W"), (F.col("vec_id") % 10).cast("string")).alias("speaker"), F.when(F.col("vec_id") % 2 == 0, "mic").otherwise("system").alias("track"), "embedding", (3.0 + F.col("vec_id") % 17).alias("talk"))

    def each(key, rows):
        placed = live.each_placed_voice((ix, track, speaker, v, talk, talk / 2) for _, ix, speaker, track, v, talk in rows)
        return ((*key, *p) for p in placed)

    out = live.over_groups(e, ["recording"], [F.col("window_ix"), F.col("track")], each, "recording bigint, window_ix bigint, track string, speaker string, voice string, score double")
    return out.withColumn("score", F.round("score", 6))


def updates(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("item"), F.when(F.col("event_type") == "purchase", " decision ").when(F.col("event_type") == "error", "note").otherwise("todo").alias("kind"),
        F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("text "), F.col("event_id").cast("string"))).alias("text"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("o"), (F.col("event_id") % 5).cast("string"))).alias("owner"), F.lit("").alias("due"),
        (1000 * F.col("event_id")).alias("at_ms"),
    )


def f16(spark, sf):
    fine, bad = live.valid_updates(updates(spark, sf))
    return fine.select("session", "seq", "kind", F.lit(True).alias("valid")).unionByName(bad.select("session", "seq", "kind", F.lit(False).alias("valid")))


def m8_simple(spark, sf):
    return live.simple_items(updates(spark, sf))


def o5(spark, sf):
    items = live.simple_items(updates(spark, sf)).withColumn("deleted", (F.col("session") + F.col("item")) % 4 == 0)
    return live.visible_items(items).select("session", "item", "place")


def m8(spark, sf):
    """Items with edits and deletions by the user."""
    u = updates(spark, sf).withColumn("item", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("T"), (F.col("seq") % 9 + 1).cast("string"))))

    names = u.columns

    def each(key, rows):
        named = (dict(zip(names, r, strict=True)) for r in rows)
        edits = (
            {"id": r["item"], "actor": "user" if r["seq"] % 8 == 0 else "model", "op": "delete" if r["seq"] % 20 == 0 else "set", "kind": r["kind"].strip(), "text": r["text"], "owner": r["owner"], "due": r["due"], "at": r["at_ms"], "section": None}
            for r in named
        )
        for k, v in live.fold_items(edits).items():
            yield (*key, k, *(v[c] for c in ("kind", "text", "owner", "at", "deleted", "locked")))

    return live.over_groups(u, ["session"], [F.col("seq")], each, "session bigint, item string, kind string, text string, owner string, at bigint, deleted boolean, locked boolean")


def s12(spark, sf):
    fine, _ = live.valid_updates(updates(spark, sf))
    return live.items_markdown(fine.withColumn("item", F.col("seq")).withColumn("at_ms", F.col("seq") * 1000))


def eval_rows(spark, sf):
    """A result for each turn: the text without every seventh word, scored by length; some errors and exclusions."""
    t = views.conv_turns(spark, sf).where("n_words > 0")
    kept = F.filter(F.split("text", " "), lambda x, i: i % 7 != 6)
    t = t.withColumn("output", F.array_join(kept, " "))
    q = F.least(F.length("output"), F.length("text")) / F.greatest(F.length("text"), F.lit(1))
    return t.select(
        (F.col("job_id") * 100 + F.col("turn")).alias("case_id"), (F.col("job_id") % 3).alias("model"), (F.col("turn") % 3).alias("prompt_id"), F.when(F.col("job_id") % 5 == 0, "mixed_task").otherwise("quality").alias("category"), "output", F.col("text").alias("expected"),
        q.alias("quality_score"), (q - 0.1).alias("granularity_score"), F.when(F.col("turn") % 4 != 0, F.round(q * 90)).alias("llmaaj_score"), (F.col("job_id") % 4 != 0).alias("llmaaj_valid_case"), (F.col("output") == F.col("text")).cast("double").alias("exact"),
        (F.col("n_words") / 10).alias("elapsed_seconds"), (F.length("output") / (F.col("n_words") / 10)).alias("chars_per_second"), F.when(F.col("job_id") % 11 == 3, "timeout").alias("error"),
    )


EVAL = """eo AS (SELECT *, array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 7 <> 6), ' ') AS output FROM conv_turns WHERE n_words > 0),
ev AS (SELECT job_id * 100 + turn AS case_id, job_id % 3 AS model, turn % 3 AS prompt_id, CASE WHEN job_id % 5 = 0 THEN 'mixed_task' ELSE 'quality' END AS category, least(length(output), length(text)) / greatest(length(text), 1) AS q,
 CASE WHEN turn % 4 <> 0 THEN round(least(length(output), length(text)) / greatest(length(text), 1) * 90) END AS j, job_id % 4 <> 0 AS valid, (output = text)::DOUBLE AS exact, n_words / 10 AS secs, length(output) / (n_words / 10) AS cps, job_id % 11 = 3 AS err FROM eo),
sm AS (SELECT model, prompt_id, count(*) FILTER (WHERE NOT err) AS n_ok, count(*) FILTER (WHERE err) AS n_error, avg(q) FILTER (WHERE NOT err) AS quality, avg(q - 0.1) FILTER (WHERE NOT err) AS granularity, avg(q) FILTER (WHERE NOT err AND category = 'mixed_task') AS mixed_quality,
 avg(j) FILTER (WHERE NOT err AND valid) AS judge, avg(exact) FILTER (WHERE NOT err) AS exact, avg(secs) FILTER (WHERE NOT err) AS seconds, avg(cps) FILTER (WHERE NOT err) AS chars_per_second FROM ev GROUP BY ALL),
s2 AS (SELECT *, list_avg(list_filter([quality * 100, granularity * 100, judge], lambda x: x IS NOT NULL)) AS performance FROM sm)"""
SUMS = ("quality", "granularity", "mixed_quality", "judge", "exact", "seconds", "chars_per_second", "performance")


def a14(spark, sf):
    s = evals.model_summaries(eval_rows(spark, sf))
    return s.withColumns({c: F.round(c, 5) for c in SUMS})


def o4(spark, sf):
    return evals.ranked(evals.model_summaries(eval_rows(spark, sf))).select("model", "prompt_id", "place")


def a15(spark, sf):
    return evals.best_prompts(eval_rows(spark, sf))


def a16(spark, sf):
    return evals.recommended(evals.model_summaries(eval_rows(spark, sf)))


def a17(spark, sf):
    return evals.test_set(eval_rows(spark, sf))


def u1(spark, sf):
    r = eval_rows(spark, sf)
    return r.select("case_id", F.round(evals.similarity(F.col("output"), F.col("expected")), 6).alias("ratio"))


def rules(spark, sf):
    """Two rules for each customer, of cases that may be there."""
    c = views.table(spark, sf, "customer")
    case = F.col("c_custkey") * 100 + F.col("c_nationkey") % 8
    r = c.select(case.alias("case_id"), F.when(F.col("c_custkey") % 2 == 0, "must_have").otherwise("must_not").alias("kind"), F.lower(F.substring("c_mktsegment", 1, 2)).alias("fragment"), (10 + F.col("c_nationkey")).alias("points"))
    return r.unionByName(r.withColumn("case_id", F.col("case_id") + 1))


def a18(spark, sf):
    r = eval_rows(spark, sf).withColumnRenamed("quality_score", "ratio").withColumn("row_id", F.col("case_id"))
    return evals.rule_judge(r, rules(spark, sf)).select("case_id", F.round("judge", 6).alias("judge"), "notes")


def j19(spark, sf):
    cases = eval_rows(spark, sf).select("case_id", "category")
    prompts = views.table(spark, sf, "region").select(F.col("r_regionkey").alias("model"), F.explode(F.sequence(F.lit(0), F.col("r_regionkey"))).alias("prompt_id"))
    return evals.grid(cases, prompts)


QUERIES = {
    "w6_fixed_chunks": w6, "w7_turn_chunks": w7, "f22_probe": f22, "t1_released_lines": t1, "w11_rolling_window": w11, "j12_marked_voices": j12, "j13_last_known_speaker": j13, "a13_fresh_talk": a13, "w13_event_numbers": w13, "w14_context_tail": w14,
    "j15_timeline": j15, "t8_gates": t8, "t9_already_said": t9, "t10_due_times": t10, "t2_step_batches": t2, "t7_sections": t7, "t5_live_voices": t5, "f16_item_updates": f16, "m8_items": m8, "m8_simple_items": m8_simple, "s12_items_markdown": s12, "t4_backlog_pieces": t4, "o3_release_order": o3, "o5_visible_items": o5,
    "a14_model_summaries": a14, "o4_ranked_models": o4, "a15_best_prompts": a15, "a16_recommended": a16, "a17_test_set": a17, "a18_rule_judge": a18, "u1_similarity": u1, "j19_evaluation_grid": j19,
}
COVER = "cv AS (SELECT recording, track, event_id AS seq, start_ms, start_ms + 300 AS end_ms, start_ms + 500 AS covered_ms FROM live)"
UPDATES = """up AS (SELECT user_id AS session, event_id AS seq, event_id % 3 AS item, CASE WHEN event_type = 'purchase' THEN 'decision' WHEN event_type = 'error' THEN 'note' ELSE 'todo' END AS kind,
 CASE WHEN event_id % 7 = 0 THEN '' ELSE 'text ' || event_id END AS text, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'o' || (event_id % 5) END AS owner FROM events)"""
CLOCK = "lpad((seq % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad((seq % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((seq % 60)::VARCHAR, 2, '0')"
with_cte = lambda cte, body, *v: sql(", " + cte + "\n" + body, *v).replace("\n, " + cte[:6], ",\n" + cte[:6]) if v else f"WITH {cte}\n{body}"
FOLD = lambda name, opens: sql(f""", lo AS MATERIALIZED (SELECT recording, event_id, start_ms, start_ms + 3000 AS end_ms, p_milli, row_number() OVER (PARTITION BY recording ORDER BY start_ms, event_id) AS rn FROM live),
st AS (SELECT *, 0::BIGINT AS number, start_ms AS first FROM lo WHERE rn = 1
 UNION ALL SELECT l.*, s.number + ({opens})::INT, CASE WHEN {opens} THEN l.start_ms ELSE s.first END FROM st s JOIN lo l ON l.recording = s.recording AND l.rn = s.rn + 1)
SELECT recording, event_id, start_ms, end_ms, p_milli, number AS {name} FROM st""", "live").replace("\n, lo AS", ",\nlo AS").replace("WITH ", "WITH RECURSIVE ", 1)  # noqa: E731
#: Sections of batches (rows of `of` by number in recording): the batch's facts, then a step for each batch.
SECTIONS = lambda of, key, longest, shortest: f""",
q AS (SELECT *, number AS batch, row_number() OVER (PARTITION BY recording, number ORDER BY start_ms, end_ms, {key}) - 1 AS place FROM {of}),
qb AS (SELECT recording, batch, count(*) AS n, arg_min(start_ms, place) AS f, arg_max(end_ms, place) AS l, arg_min(p_milli, place) AS p, arg_min({key}, place) % count(*) AS cut FROM q GROUP BY ALL),
qc AS MATERIALIZED (SELECT qb.*, q.start_ms AS chosen FROM qb JOIN q ON qb.recording = q.recording AND qb.batch = q.batch AND q.place = qb.cut),
ss AS (SELECT recording, batch, 0::BIGINT AS head, 0::BIGINT AS tail, f AS opened, l AS last, cut FROM qc WHERE batch = 0
 UNION ALL SELECT c.recording, c.batch, s.tail + (s.last - s.opened >= {longest})::INT, s.tail + (s.last - s.opened >= {longest} OR (s.last - s.opened >= {shortest} AND c.p >= 600))::INT,
  CASE WHEN s.last - s.opened >= {longest} THEN c.f WHEN s.last - s.opened >= {shortest} AND c.p >= 600 THEN c.chosen ELSE s.opened END, c.l, c.cut FROM ss s JOIN qc c ON c.recording = s.recording AND c.batch = s.batch + 1)"""  # noqa: E731
ORACLES = {
    "t2_step_batches": FOLD("batch", "s.end_ms - s.first >= 30000000"),
    "t4_backlog_pieces": FOLD("piece", "l.end_ms - s.first > 100000000"),
    "t7_sections": FOLD("batch", "s.end_ms - s.first >= 30000000").rsplit("\nSELECT", 1)[0] + SECTIONS("""st""", "event_id", 900_000_000, 60_000_000)
    + " SELECT recording, batch, start_ms, end_ms, event_id, p_milli, CASE WHEN place < cut THEN head ELSE tail END AS section FROM q JOIN ss USING (recording, batch)",
    "o5_visible_items": with_cte(UPDATES, "SELECT session, item, row_number() OVER (PARTITION BY session ORDER BY since, item) AS place FROM (SELECT session, item, min(seq) AS since FROM up GROUP BY ALL) WHERE (session + item) % 4 <> 0"),
    "w6_fixed_chunks": with_cte("sp AS (SELECT job_id, max(end_ms) AS e, greatest(1, ceil((max(end_ms) - 2000) / 88000)::BIGINT) AS n FROM conv_turns GROUP BY job_id HAVING max(end_ms) > 0)", "SELECT job_id, k::INT AS chunk_ix, k * 88000 AS start_ms, least(k * 88000 + 90000, e) AS end_ms FROM (SELECT *, unnest(range(n)) AS k FROM sp)", "conv_turns"),
    "w7_turn_chunks": sql(""", du AS (SELECT job_id, max(end_ms) AS d FROM conv_turns GROUP BY job_id),
tu AS MATERIALIZED (SELECT job_id, a, b, row_number() OVER (PARTITION BY job_id ORDER BY a0, b0) AS rn, d FROM (SELECT t.job_id, greatest(0, t.start_ms) AS a, least(t.end_ms, d) AS b, t.start_ms AS a0, t.end_ms AS b0, d FROM turns t JOIN du USING (job_id)) WHERE b > a),
fo AS (SELECT job_id, rn, a AS s, b AS r, NULL::BIGINT AS cs, NULL::BIGINT AS ce FROM tu WHERE rn = 1
 UNION ALL SELECT t.job_id, t.rn, CASE WHEN t.b - f.s > 90000 AND f.r > f.s THEN greatest(0, f.r - 2000) ELSE f.s END, greatest(f.r, t.b), CASE WHEN t.b - f.s > 90000 AND f.r > f.s THEN f.s END, CASE WHEN t.b - f.s > 90000 AND f.r > f.s THEN f.r END FROM fo f JOIN tu t ON t.job_id = f.job_id AND t.rn = f.rn + 1),
la AS (SELECT job_id, arg_max(s, rn) AS s, arg_max(r, rn) AS r, max(rn) AS n FROM fo GROUP BY job_id),
sp AS (SELECT job_id, -1 AS o, 0 AS a, a AS b FROM tu WHERE rn = 1 AND a > 0 UNION ALL SELECT job_id, rn, cs, ce FROM fo WHERE cs IS NOT NULL UNION ALL SELECT job_id, n + 1, s, r FROM la
 UNION ALL SELECT du.job_id, 1000000000, CASE WHEN la.job_id IS NULL THEN 0 ELSE greatest(0, r - 2000) END, d FROM du LEFT JOIN la USING (job_id) WHERE coalesce(r, 0) < d),
ct AS (SELECT *, CASE WHEN b - a > 90000 THEN ceil((b - a - 90000) / 88000)::BIGINT ELSE 0 END AS n FROM sp),
cx AS (SELECT job_id, o, k, a + k * 88000 AS start_ms, CASE WHEN k = n THEN b ELSE a + k * 88000 + 90000 END AS end_ms FROM (SELECT *, unnest(range(n + 1)) AS k FROM ct))
SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY o, k) - 1)::INT AS chunk_ix, start_ms, end_ms FROM cx""", "turns").replace("\n, du AS", ",\ndu AS").replace("WITH ", "WITH RECURSIVE ", 1),
    "f22_probe": sql("SELECT job_id, turn_ix, start_ms, least(end_ms, 300000) AS end_ms, duration_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY job_id) AS duration_ms FROM turns) WHERE start_ms < 300000", "turns"),
    "t1_released_lines": with_cte(COVER, """SELECT l.recording, l.track, l.seq, CASE WHEN count(c.seq) FILTER (WHERE c.track = 'mic') > 0 AND count(c.seq) FILTER (WHERE c.track = 'system') > 0 THEN greatest(l.seq, min(c.seq) FILTER (WHERE c.track = 'mic'), min(c.seq) FILTER (WHERE c.track = 'system')) END AS released_at
 FROM cv l LEFT JOIN cv c ON c.recording = l.recording AND c.covered_ms > l.start_ms GROUP BY l.recording, l.track, l.seq""", "live"),
    "o3_release_order": with_cte(COVER, """SELECT recording, track, seq, row_number() OVER (PARTITION BY recording ORDER BY released_at, start_ms, end_ms, track, seq) AS place FROM (SELECT l.recording, l.track, l.seq, l.start_ms, l.end_ms, CASE WHEN count(c.seq) FILTER (WHERE c.track = 'mic') > 0 AND count(c.seq) FILTER (WHERE c.track = 'system') > 0 THEN greatest(l.seq, min(c.seq) FILTER (WHERE c.track = 'mic'), min(c.seq) FILTER (WHERE c.track = 'system')) END AS released_at
 FROM cv l LEFT JOIN cv c ON c.recording = l.recording AND c.covered_ms > l.start_ms GROUP BY l.recording, l.track, l.seq, l.start_ms, l.end_ms) WHERE released_at IS NOT NULL""", "live"),
    "w11_rolling_window": with_cte(COVER, """, p AS (SELECT recording, track, seq, start_ms // 1000 AS start_ms, start_ms // 1000 + 3600 AS end_ms FROM cv),
q AS (SELECT *, start_ms - max(end_ms) OVER (PARTITION BY recording, track ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM p),
r AS (SELECT *, sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, track ORDER BY start_ms, seq)::BIGINT AS stretch FROM q)
SELECT recording, track, seq, stretch, count(*) OVER w AS n_window, min(start_ms) OVER w AS window_start FROM r WINDOW w AS (PARTITION BY recording, track, stretch ORDER BY start_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)""", "live"),
    "j12_marked_voices": sql("""SELECT c.job_id AS recording, c.turn AS mark, b.speaker FROM conv_turns c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, turn ORDER BY o DESC, speaker) AS rn FROM
 (SELECT c.job_id, c.turn, t.speaker, max(least(c.start_ms + 700, t.end_ms) - greatest(c.start_ms - 3800, t.start_ms)) AS o FROM conv_turns c JOIN turns t ON c.job_id = t.job_id AND t.start_ms < c.start_ms + 700 AND c.start_ms - 3800 < t.end_ms GROUP BY ALL)) WHERE rn = 1) b
 ON c.job_id = b.job_id AND c.turn = b.turn""", "turns"),
    "j13_last_known_speaker": sql("SELECT recording, track, event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY recording, track ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker FROM live", "live"),
    "a13_fresh_talk": sql("SELECT job_id AS recording, turn_ix // 2 AS window_ix, speaker, sum(greatest(0, end_ms - start_ms))::BIGINT AS talk_ms, sum(greatest(0, end_ms - start_ms - 2000 * (turn_ix % 3)))::BIGINT AS fresh_ms FROM turns GROUP BY ALL", "turns"),
    "w13_event_numbers": "SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events",
    "w14_context_tail": sql(", u AS (SELECT job_id AS session, turn AS seq, sum(length(text) + 1) OVER (PARTITION BY job_id ORDER BY turn DESC) AS used, count(*) OVER (PARTITION BY job_id) AS n FROM conv_turns) SELECT session, seq, count(*) OVER (PARTITION BY session) < n AS cut FROM u WHERE used <= 2000", "conv_turns").replace("\n, u AS", ",\nu AS"),
    "j15_timeline": sql("""SELECT *, row_number() OVER (PARTITION BY recording ORDER BY at_ms, rank, text) AS place FROM (SELECT job_id AS recording, start_ms AS at_ms, 1 AS rank, text FROM conv_turns UNION ALL SELECT job_id, start_ms, 0, '# part ' || turn FROM conv_turns WHERE turn % 3 = 0
 UNION ALL SELECT job_id, start_ms, 2, '> on ' || turn FROM conv_turns WHERE turn % 2 = 1)""", "conv_turns"),
    "t8_gates": sql("SELECT recording, event_id, p_milli >= 500 AND recording % 5 <> 0 AS comment, event_type IN ('purchase', 'click') AND p_milli >= 500 AS items FROM live", "live"),
    "t9_already_said": sql("""SELECT b.recording, b.start_ms // 86400000 AS section, b.event_id AS batch, count(*) AS n_known, max(c.event_id) AS latest FROM live b JOIN live c ON b.recording = c.recording AND b.start_ms // 86400000 = c.start_ms // 86400000 AND c.start_ms <= b.start_ms
 WHERE b.event_type = 'view' AND c.event_type = 'click' GROUP BY ALL""", "live"),
    "t10_due_times": with_cte(COVER, "SELECT recording, seq, round((end_ms - min(start_ms) OVER (PARTITION BY recording)) / 4.0)::BIGINT AS due_ms FROM cv", "live"),
    "f16_item_updates": with_cte(UPDATES, "SELECT session, seq, kind, kind IN ('decision', 'todo') AND text <> '' AS valid FROM up"),
    "m8_items": with_cte(UPDATES, """, m AS MATERIALIZED (SELECT session, seq, CASE WHEN seq % 4 = 0 THEN 'T' || (seq % 9 + 1) END AS key, seq % 8 = 0 AS usr, seq % 20 = 0 AS del, kind, text, owner, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM up),
it AS (SELECT session, 0::BIGINT AS rn, []::STRUCT(id VARCHAR, kind VARCHAR, text VARCHAR, owner VARCHAR, at_ms BIGINT, deleted BOOLEAN, locked BOOLEAN)[] AS xs FROM m WHERE rn = 1
 UNION ALL SELECT session, rn, CASE
  WHEN usr AND (pos IS NULL OR pos = 0 OR xs[pos].deleted OR (NOT del AND text = '')) THEN xs
  WHEN usr THEN list_transform(xs, lambda x, i: CASE WHEN i <> pos THEN x WHEN del THEN struct_pack(id := x.id, kind := x.kind, text := x.text, owner := x.owner, at_ms := x.at_ms, deleted := true, locked := true)
   ELSE struct_pack(id := x.id, kind := x.kind, text := text, owner := owner, at_ms := x.at_ms, deleted := x.deleted, locked := true) END)
  WHEN del THEN xs
  WHEN pos > 0 THEN list_transform(xs, lambda x, i: CASE WHEN i <> pos OR x.locked THEN x ELSE struct_pack(id := x.id, kind := x.kind, text := coalesce(nullif(text, ''), x.text), owner := coalesce(nullif(owner, ''), x.owner), at_ms := x.at_ms, deleted := x.deleted, locked := x.locked) END)
  WHEN kind IN ('decision', 'todo') AND text <> '' THEN list_append(xs, struct_pack(id := upper(kind[1]) || (len(list_filter(xs, lambda x: x.kind = kind)) + 1), kind := kind, text := text, owner := owner, at_ms := seq * 1000, deleted := false, locked := false))
  ELSE xs END FROM (SELECT m.*, it.xs, list_position(list_transform(it.xs, lambda x: x.id), m.key) AS pos FROM it JOIN m ON m.session = it.session AND m.rn = it.rn + 1)),
fi AS (SELECT session, unnest(xs) AS x FROM it QUALIFY row_number() OVER (PARTITION BY session ORDER BY rn DESC) = 1)
SELECT session, x.id AS item, x.kind AS kind, x.text AS text, x.owner AS owner, x.at_ms AS "at", x.deleted AS deleted, x.locked AS locked FROM fi""").replace("WITH ", "WITH RECURSIVE ", 1),
    "m8_simple_items": with_cte(UPDATES, "SELECT session, item, arg_max(text, seq) FILTER (WHERE text <> '') AS text, arg_max(owner, seq) FILTER (WHERE owner <> '') AS owner, min(seq) * 1000 AS at_ms FROM up GROUP BY ALL"),
    "s12_items_markdown": with_cte(UPDATES, f""", ok AS (SELECT session, seq, kind, CASE WHEN kind = 'todo' THEN '- [ ] ' ELSE '- ' END || text || CASE WHEN owner <> '' THEN ' (owner: ' || owner || ')' ELSE '' END || ' [' || {CLOCK} || ']' AS l FROM up WHERE kind IN ('decision', 'todo') AND text <> '')
SELECT session, '## Decisions' || chr(10) || chr(10) || coalesce(string_agg(l, chr(10) ORDER BY seq) FILTER (WHERE kind = 'decision'), 'None.') || chr(10) || chr(10) || '## To-dos' || chr(10) || chr(10) || coalesce(string_agg(l, chr(10) ORDER BY seq) FILTER (WHERE kind = 'todo'), 'None.') || chr(10) AS markdown FROM ok GROUP BY session"""),
    "a14_model_summaries": with_cte(EVAL, "SELECT model, prompt_id, n_ok, n_error, " + ", ".join(f"round({c}, 5) AS {c}" for c in SUMS) + " FROM s2", "conv_turns"),
    "o4_ranked_models": with_cte(EVAL, "SELECT model, prompt_id, row_number() OVER (ORDER BY judge IS NULL, judge DESC NULLS LAST, performance DESC NULLS LAST, chars_per_second DESC NULLS LAST, model, prompt_id) AS place FROM s2", "conv_turns"),
    "a15_best_prompts": with_cte(EVAL, """, g AS (SELECT model, CASE WHEN category = 'mixed_task' THEN 'mixed' ELSE 'plain' END AS use_case, prompt_id, avg(j) AS j, avg(q) AS q, avg(q - 0.1) AS gr, avg(cps) AS cps FROM ev WHERE NOT err GROUP BY ALL)
SELECT model, use_case, first(prompt_id ORDER BY coalesce(j, -1) DESC, q DESC, gr DESC, cps DESC, prompt_id) AS prompt_id, count(*) AS n_prompts FROM g GROUP BY model, use_case""", "conv_turns"),
    "a16_recommended": with_cte(EVAL, """SELECT 'best' AS pick, model, prompt_id FROM (SELECT *, row_number() OVER (ORDER BY coalesce(judge, -1) DESC, coalesce(performance, -1) DESC, chars_per_second DESC, model, prompt_id) AS rn FROM s2) WHERE rn = 1
 UNION ALL SELECT 'fastest', model, prompt_id FROM (SELECT *, row_number() OVER (ORDER BY chars_per_second DESC, model, prompt_id) AS rn FROM s2 WHERE judge >= 60) WHERE rn = 1""", "conv_turns"),
    "a17_test_set": with_cte(EVAL, "SELECT count(DISTINCT case_id) AS n_cases, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT CASE WHEN NOT valid THEN case_id END) AS n_excluded FROM ev", "conv_turns"),
    "a18_rule_judge": with_cte(EVAL, """, ru AS (SELECT unnest([c_custkey * 100 + c_nationkey % 8, c_custkey * 100 + c_nationkey % 8 + 1]) AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'must_have' ELSE 'must_not' END AS kind, lower(substr(c_mktsegment, 1, 2)) AS fragment, 10 + c_nationkey AS points FROM customer),
r AS (SELECT job_id * 100 + turn AS case_id, output, text, least(length(output), length(text)) / greatest(length(text), 1) AS ratio FROM eo),
f AS (SELECT case_id, sum(points) AS lost, string_agg(kind || ':' || fragment, ';' ORDER BY kind || ':' || fragment) AS notes FROM r JOIN ru USING (case_id) WHERE (kind = 'must_have') <> contains(lower(output), fragment) GROUP BY case_id)
SELECT case_id, round(CASE WHEN trim(output) = '' THEN 0.0 WHEN output = text THEN 100.0 ELSE greatest(0.0, least(100.0, 100 * ratio - coalesce(lost, 0))) END, 6) AS judge, coalesce(notes, '') AS notes FROM r LEFT JOIN f USING (case_id)""", "conv_turns"),
    "j19_evaluation_grid": with_cte(EVAL, "SELECT case_id, category, r_regionkey AS model, p::INT AS prompt_id FROM ev, (SELECT r_regionkey, unnest(range(r_regionkey + 1)) AS p FROM region)", "conv_turns"),
}
