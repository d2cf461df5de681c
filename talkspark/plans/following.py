"""Queries of live meetings followed as streams, with their SQL.

What the streams read is written from the given tables, a part of each meeting at a time; a stream runs over what is there after each
part and goes on from its checkpoint for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.operators import voices
from talkspark.operators.places import stored
from talkspark.plans import meetings, views
from talkspark.plans.oracle_views import VIEWS, sql
from talkspark.sources.shared import new_path
from talkspark.streaming import following, stateful
from talkspark.streaming.ledger import Ledger, follow

#: Parts of a meeting that are fed one after the other: its first pieces of PART_MS, then the rest.
PARTS, PART_MS = 3, 90_000


def part_of(ms: Column) -> Column:
    return F.least(F.floor(ms / PART_MS), F.lit(PARTS - 1))


def fed(spark: SparkSession, rows: DataFrame, part: Column, run: Callable[[DataFrame, int], None]) -> None:
    """Write rows part by part, and run(stream over all that is there, part) after each. Rows are made once."""
    source = new_path(spark, "fed")
    made = stored(rows.withColumn("__part", part), "parts")
    for k in range(PARTS):
        made.where(F.col("__part") == k).drop("__part").write.mode("append").parquet(source)
        run(spark.readStream.schema(rows.schema).parquet(source), k)


class Stop(RuntimeError):
    """A crash that a query makes itself."""


def stopping_at(places: set[tuple[int, str]]) -> Callable[[int, str], None]:
    """Fails once at each (batch, what is about to be written)."""
    def crash(batch: int, where: str) -> None:
        if (batch, where) in places:
            places.discard((batch, where))
            raise Stop(f"stopped before {where} of batch {batch}")

    return crash


def restarted(stream: DataFrame, ledger: Ledger, step, crash: Callable[[int, str], None]) -> None:
    """follow(), started again after each crash of the query's own."""
    for _ in range(5):
        try:
            return follow(stream, ledger, step, crash)
        except StreamingQueryException as e:
            if "Stop: " not in str(e):
                raise
    raise RuntimeError("the stream doesn't get on")


def released(spark, sf) -> Ledger:
    """Lines of live pieces, released by a stream that stops in the middle of a batch, and once between its writes and the log's entry."""
    ledger = Ledger(spark, new_path(spark, "release"))
    rows = views.live_pieces(spark, sf).select("recording", "track", "seq", "start_ms", "end_ms", (F.col("end_ms") + 100).alias("covered_ms"))
    crash = stopping_at({(1, "pending"), (2, "log")})
    fed(spark, rows, part_of(F.col("start_ms")), lambda stream, k: restarted(stream, ledger, following.release_step, crash))
    return ledger


def t11(spark, sf):
    return released(spark, sf).read("lines", following.LINE).select("recording", "track", "seq", "start_ms", "batch")


def s5(spark, sf):
    return following.progress(released(spark, sf))


def t13(spark, sf):
    """Words in pieces of 90 s, with the turns that each touches first, as lines."""
    ledger = Ledger(spark, new_path(spark, "pieces"))
    none = lambda kind: F.lit(None).cast(kind)
    w = views.words(spark, sf).select(F.lit("word").alias("kind"), "job_id", "chunk_ix", "pos", "word", none("int").alias("turn_ix"), none("string").alias("speaker"), "start_ms", "end_ms")
    first = F.floor(F.greatest(F.lit(0), F.col("start_ms") - 300) / PART_MS)  # a piece's last word may end 300 ms after it
    t = views.turns(spark, sf).select(F.lit("turn").alias("kind"), "job_id", first.alias("chunk_ix"), none("bigint").alias("pos"), none("string").alias("word"), F.col("turn_ix").cast("int").alias("turn_ix"), "speaker", "start_ms", "end_ms")
    fed(spark, w.unionByName(t), F.least(F.col("chunk_ix"), F.lit(PARTS - 1)), lambda stream, k: follow(stream, ledger, following.pieces_step))
    return ledger.read("piece_lines", following.PIECE_LINE).drop("batch")


def named(spark, sf, part: int) -> DataFrame:
    """Names of voices as they are at a part of the meetings: users get one at the second, some another at the third, assistants of some at the third."""
    who = views.conv_turns(spark, sf).select(F.col("job_id").alias("recording"), F.col("speaker").alias("voice")).distinct()
    user = F.when((F.lit(part) == 2) & (F.col("recording") % 5 == 0), "Mira").when((F.lit(part) >= 1) & (F.col("recording") % 2 == 0), "Ann")
    name = F.when(F.col("voice") == "user", user).when((F.lit(part) == 2) & (F.col("voice") == "assistant") & (F.col("recording") % 3 == 0), "Piet")
    return who.withColumn("name", name).where("name is not null")


def j14(spark, sf):
    ledger = Ledger(spark, new_path(spark, "relabel"))
    rows = views.live_pieces(spark, sf).select("recording", F.col("seq").alias("line_ix"), "voice")

    def run(stream: DataFrame, k: int) -> None:
        follow(stream, ledger, lambda batch, log: following.relabel_step(batch, log, named(spark, sf, k)))

    fed(spark, rows, part_of(F.col("line_ix")), run)
    return following.displayed(ledger)


def stateful_rows(spark, rows: DataFrame, part: Column, made: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What a stream with typed state gives for rows fed in parts; update or append alike."""
    out, checkpoint = new_path(spark, "stateful"), new_path(spark, "stateful-checkpoint")

    def run(stream: DataFrame, k: int) -> None:
        with stateful.typed_state(spark):
            write = made(stream).writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            # with processing-time timers a stream over what is there would never end: one batch for each part
            once = {"once": True} if made in (stateful.released_with_idle, long_batches) else {"availableNow": True}
            write.outputMode("update" if made is stateful.placed_voices else "append").option("checkpointLocation", checkpoint).trigger(**once).start().awaitTermination()

    fed(spark, rows, part, run)
    return spark.read.schema(f"{schema}, batch int").parquet(out)


def t3(spark, sf):
    """Pieces of live meetings whose tracks are silent while the other one speaks."""
    rows = views.live_pieces(spark, sf).select("recording", "track", "seq", "start_ms", "end_ms", (F.col("end_ms") + 100).alias("covered_ms"), (F.col("end_ms") + 200).alias("heard_ms"))
    return stateful_rows(spark, rows, part_of(F.col("start_ms")), stateful.released_with_idle, stateful.ReleaseWithIdle.OUT).drop("batch")


def long_batches(lines: DataFrame) -> DataFrame:
    return stateful.step_batches(lines, stale=10**9)  # nothing grows stale while the query runs


def t2(spark, sf):
    """Step batches that are long enough."""
    rows = views.live_pieces(spark, sf).select("recording", "seq", "start_ms", "end_ms")
    return stateful_rows(spark, rows, part_of(F.col("start_ms")), long_batches, stateful.StepBatches.OUT).select("recording", "number", "seq")


def t6(spark, sf):
    """A mark 0.2 s after each turn's start; windows of pieces, some of which nobody is recognised in."""
    p = views.live_pieces(spark, sf).where("(turn + k) % 3 <> 0")
    windows = p.select("recording", F.col("end_ms").alias("time_ms"), F.lit(True).alias("is_window"), "voice", F.greatest("turn_start", F.col("end_ms") - 60_000).alias("a"), F.col("end_ms").alias("b"))
    marks = views.conv_turns(spark, sf).select(F.col("job_id").alias("recording"), (F.col("start_ms") + 200).alias("time_ms"), F.lit(False).alias("is_window"), F.lit(None).cast("string").alias("voice"), F.col("turn").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    # a clock's row after all others, so that the timers of the last marks go off
    clock = spark.range(1).select(F.lit(-1).cast("bigint").alias("recording"), F.lit(10**12).cast("bigint").alias("time_ms"), F.lit(True).alias("is_window"), F.lit("").alias("voice"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    rows = windows.unionByName(marks).unionByName(clock).withColumn("at", F.timestamp_millis("time_ms"))
    return stateful_rows(spark, rows, part_of(F.col("time_ms")), stateful.settled_marks, stateful.SettleMarks.OUT).drop("batch")


def windows(spark, sf):
    """Windows of a recording for every 50 vectors, ten speakers each."""
    return views.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("recording"), F.floor(F.col("vec_id") % 50 / 10).alias("window_ix"), F.when(F.col("vec_id") % 2 == 0, "mic").otherwise("system").alias("track"),
        F.concat(F.lit("W"), (F.col("vec_id") % 10).cast("string")).alias("speaker"), F.col("embedding").cast("array<double>").alias("embedding"), (3.0 + F.col("vec_id") % 17).alias("talk"), ((3.0 + F.col("vec_id") % 17) / 2).alias("fresh"),
    )


def placed(spark, sf) -> DataFrame:
    return stateful_rows(spark, windows(spark, sf), F.floor(F.col("window_ix") / 2), stateful.placed_voices, stateful.PlaceVoices.OUT)


def t5(spark, sf):
    return placed(spark, sf).where("kind = 'placed'").select("recording", "window_ix", "track", "speaker", "voice", F.round("score", 6).alias("score"))


def t12(spark, sf):
    """Each voice as it is at the end, with the registry's nearest name."""
    last = placed(spark, sf).where("kind = 'voice'").groupBy("recording", "voice").agg(F.max_by(F.struct("track", "window_ix", "seconds", "print"), "batch").alias("v")).select("recording", "voice", "v.*")
    asked = last.select(F.lit("test:64").alias("namespace"), F.concat_ws("/", "recording", "voice").alias("print_id"), F.col("print").alias("embedding"))
    near = voices.best_voice(asked, voices.centroids(views.voice_members(spark, sf)))
    out = last.withColumn("print_id", F.concat_ws("/", "recording", "voice")).join(near.select("print_id", "name", "score"), "print_id")
    return out.select("recording", "voice", "track", "window_ix", F.round("seconds", 3).alias("seconds"), F.col("name").alias("match"), F.round("score", 6).alias("score"))


def t7(spark, sf):
    """Sections of live pieces by a stream: step batches of each part, then sections that go on from the part before."""
    ledger = Ledger(spark, new_path(spark, "sections"))
    rows = views.live_pieces(spark, sf).select("recording", "seq", "start_ms", "end_ms", F.pmod(F.col("turn") * 379 + F.col("k") * 211 + F.col("recording") * 17, F.lit(1000)).alias("p_milli"))
    fed(spark, rows, part_of(F.col("start_ms")), lambda stream, k: follow(stream, ledger, following.sections_step))
    return ledger.read("sectioned", following.SECTIONED).select("recording", "seq", "section")


QUERIES = {
    "t7_section_stream": t7, "t2_step_stream": t2,
    "t13_piece_lines": t13, "t11_resumed_lines": t11, "s5_recording_progress": s5, "t3_idle_release": t3, "t6_settled_marks": t6, "t5_voice_stream": t5, "t12_voice_snapshot": t12, "j14_relabelled_lines": j14,
}
P = f"least(start_ms // {PART_MS}, {PARTS - 1})"
RELEASE = f""", cv AS (SELECT *, end_ms + 100 AS covered_ms, {P} AS part FROM pieces),
lv AS (SELECT a.recording, p.part, max(covered_ms) FILTER (WHERE a.track = 'mic') AS m, max(covered_ms) FILTER (WHERE a.track = 'system') AS s FROM cv a JOIN (SELECT unnest(range({PARTS})) AS part) p ON a.part <= p.part GROUP BY ALL),
rl AS (SELECT cv.recording, track, seq, start_ms, min(lv.part) FILTER (WHERE m IS NOT NULL AND s IS NOT NULL AND least(m, s) > start_ms) AS batch FROM cv JOIN lv ON cv.recording = lv.recording AND lv.part >= cv.part GROUP BY ALL)"""
FALLBACK = """, pc AS (SELECT job_id, chunk_ix, min(start_ms) AS s, max(end_ms) AS e FROM words GROUP BY ALL),
po AS (SELECT pc.job_id, pc.chunk_ix, t.speaker, sum(least(e, t.end_ms) - greatest(s, t.start_ms)) AS o, min(t.turn_ix) AS f FROM pc JOIN turns t ON pc.job_id = t.job_id AND t.start_ms < e AND s < t.end_ms GROUP BY ALL),
pt AS (SELECT job_id, chunk_ix, speaker AS top FROM po QUALIFY row_number() OVER (PARTITION BY job_id, chunk_ix ORDER BY o DESC, f) = 1),
pf AS (SELECT pc.job_id, pc.chunk_ix, coalesce(last_value(top IGNORE NULLS) OVER (PARTITION BY pc.job_id ORDER BY pc.chunk_ix), 'mic') AS fallback FROM pc LEFT JOIN pt USING (job_id, chunk_ix)),
segf AS (SELECT segw.* REPLACE (CASE WHEN speaker = 'UNKNOWN' THEN fallback ELSE speaker END AS speaker) FROM segw JOIN pf USING (job_id, chunk_ix)),
"""
IDLE = f""", r AS (SELECT *, end_ms + 100 AS c, end_ms + 200 AS h FROM pieces),
g AS (SELECT *, max(c) FILTER (WHERE track = 'mic') OVER w AS gm, max(c) FILTER (WHERE track = 'system') OVER w AS gs, coalesce(max(h) FILTER (WHERE track = 'mic') OVER w, min(h) OVER (PARTITION BY recording)) AS hm,
 coalesce(max(h) FILTER (WHERE track = 'system') OVER w, min(h) OVER (PARTITION BY recording)) AS hs FROM r WINDOW w AS (PARTITION BY recording ORDER BY seq)),
k AS (SELECT *, greatest(coalesce(gm, -1), coalesce(max(CASE WHEN track = 'system' AND h - hm >= {stateful.IDLE_AFTER_MS} THEN gs - {stateful.IDLE_MS} END) OVER w, -1)) AS cm,
 greatest(coalesce(gs, -1), coalesce(max(CASE WHEN track = 'mic' AND h - hs >= {stateful.IDLE_AFTER_MS} THEN gm - {stateful.IDLE_MS} END) OVER w, -1)) AS cs FROM g WINDOW w AS (PARTITION BY recording ORDER BY seq))
SELECT l.recording, l.track, l.seq, l.start_ms, l.end_ms, min(k.seq) AS released_at FROM r l JOIN k ON l.recording = k.recording AND k.seq >= l.seq AND least(cm, cs) > l.start_ms GROUP BY ALL"""
MARKS = f""", m AS (SELECT job_id AS recording, turn AS mark, start_ms + 200 AS at_ms FROM conv_turns),
w AS (SELECT recording, voice, end_ms AS reached, greatest(turn_start, end_ms - 60000) AS a, end_ms AS b FROM pieces WHERE (turn + k) % 3 <> 0),
o AS (SELECT m.recording, mark, at_ms, voice, reached, greatest(0, least(at_ms + 500, b) - greatest(at_ms - 4000, a)) AS ms FROM m JOIN w ON m.recording = w.recording AND reached >= at_ms AND reached <= at_ms + {stateful.GIVE_UP_MS}),
f AS (SELECT *, max(ms) OVER (PARTITION BY recording, mark ORDER BY reached) > 0 AS any_heard FROM o),
c AS (SELECT recording, mark, coalesce(min(reached) FILTER (WHERE any_heard AND reached >= at_ms + {stateful.SETTLE_MS}), max(at_ms) + {stateful.GIVE_UP_MS}) AS till FROM f GROUP BY ALL),
v AS (SELECT f.recording, f.mark, voice, max(ms) AS ms, min(reached) FILTER (WHERE ms > 0) AS since FROM f JOIN c ON f.recording = c.recording AND f.mark = c.mark AND reached <= till GROUP BY ALL HAVING max(ms) > 0),
b AS (SELECT recording, mark, voice FROM v QUALIFY row_number() OVER (PARTITION BY recording, mark ORDER BY ms DESC, since) = 1)
SELECT m.recording, m.mark::BIGINT AS mark, CASE WHEN voice IS NULL THEN 'nobody' ELSE 'named' END AS state, voice FROM m LEFT JOIN b ON m.recording = b.recording AND m.mark = b.mark"""
#: The voices of a recording row by row: of the free ones and of all on the track the nearest, then the choice.
PLACED = """e AS (SELECT vec_id // 50 AS recording, (vec_id % 50) // 10 AS window_ix, 'W' || (vec_id % 10) AS speaker, CASE WHEN vec_id % 2 = 0 THEN 'mic' ELSE 'system' END AS track, embedding::DOUBLE[] AS v, 3.0 + vec_id % 17 AS talk FROM embeddings),
n AS MATERIALIZED (SELECT * EXCLUDE v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, talk / 2 AS fresh, row_number() OVER (PARTITION BY recording ORDER BY window_ix, track, talk DESC, speaker) AS rn,
 row_number() OVER (PARTITION BY recording, window_ix, track ORDER BY talk DESC, speaker) AS k FROM e),
st AS (SELECT recording, 0::BIGINT AS rn, []::STRUCT(track VARCHAR, total DOUBLE[], seconds DOUBLE, last BIGINT)[] AS vs, []::BIGINT[] AS taken, NULL::BIGINT AS pick, NULL::DOUBLE AS score FROM n WHERE rn = 1
 UNION ALL SELECT recording, rn,
  CASE WHEN pick > len(vs) THEN list_append(vs, struct_pack(track := track, total := list_transform(u, lambda x: x * fresh), seconds := fresh, last := window_ix))
   ELSE list_transform(vs, lambda x, i: CASE WHEN i = pick THEN struct_pack(track := x.track, total := list_transform(x.total, lambda y, j: y + u[j] * fresh), seconds := x.seconds + fresh, last := window_ix) ELSE x END) END,
  list_append(taken, pick), pick, coalesce(score, 1.0)
 FROM (SELECT *, CASE WHEN free.s >= 0.6 THEN free.i WHEN near IS NOT NULL AND talk < 10 THEN coalesce(free.i, near.i) ELSE len(vs) + 1 END AS pick, CASE WHEN free.s >= 0.6 THEN free.s WHEN near IS NOT NULL AND talk < 10 THEN coalesce(free.s, near.s) END AS score
 FROM (SELECT *, list_extract(list_sort(list_filter(cs, lambda c: NOT list_contains(taken, c.i)), 'DESC'), 1) AS free, list_extract(list_sort(cs, 'DESC'), 1) AS near
 FROM (SELECT *, list_filter(list_transform(vs, lambda x, i: struct_pack(s := CASE WHEN x.track = track THEN list_cosine_similarity(u, x.total) END, i := i)), lambda c: c.s IS NOT NULL) AS cs
 FROM (SELECT l.*, st.vs, CASE WHEN l.k = 1 THEN [] ELSE st.taken END AS taken FROM st JOIN n l ON l.recording = st.recording AND l.rn = st.rn + 1))))),
pl AS (SELECT n.*, 'S' || st.pick AS voice, st.score, st.vs FROM st JOIN n ON st.recording = n.recording AND st.rn = n.rn)"""
ORACLES = {
    "t11_resumed_lines": sql(RELEASE + " SELECT recording, track, seq, start_ms, batch::INT AS batch FROM rl WHERE batch IS NOT NULL", "pieces").replace("\n, cv AS", ",\ncv AS"),
    "s5_recording_progress": sql(RELEASE + " SELECT recording, track, max(covered_ms) AS covered_ms, count(*) FILTER (WHERE batch IS NULL) AS n_pending FROM cv JOIN rl USING (recording, track, seq) GROUP BY ALL", "pieces").replace("\n, cv AS", ",\ncv AS"),
    "t13_piece_lines": sql(FALLBACK + VIEWS["lines"].replace("FROM segw)", "FROM segf)") + " SELECT job_id, line_no, speaker, start_ms, end_ms, text FROM lines", "segs").replace("\n, pc AS", ",\npc AS"),
    "t3_idle_release": sql(IDLE, "pieces").replace("\n, r AS", ",\nr AS"),
    "t7_section_stream": sql(f""", po AS (SELECT recording, seq, start_ms, end_ms, (turn * 379 + k * 211 + recording * 17) % 1000 AS p_milli, {P} AS part, row_number() OVER (PARTITION BY recording, {P} ORDER BY start_ms) AS rn FROM pieces),
pb AS (SELECT *, 0::BIGINT AS number, start_ms AS first FROM po WHERE rn = 1
 UNION ALL SELECT l.*, s.number + (s.end_ms - s.first >= 30000)::INT, CASE WHEN s.end_ms - s.first >= 30000 THEN l.start_ms ELSE s.first END FROM pb s JOIN po l ON l.recording = s.recording AND l.part = s.part AND l.rn = s.rn + 1),
pn AS (SELECT * EXCLUDE number, dense_rank() OVER (PARTITION BY recording ORDER BY part, number) - 1 AS number FROM pb)""" + meetings.SECTIONS("pn", "seq", 150_000, 20_000) + " SELECT recording, seq, CASE WHEN place < cut THEN head ELSE tail END AS section FROM q JOIN ss USING (recording, batch)", "pieces").replace("\n, po AS", ",\npo AS").replace("WITH ", "WITH RECURSIVE ", 1),
    "t2_step_stream": sql(f""", po AS (SELECT recording, seq, start_ms, end_ms, row_number() OVER (PARTITION BY recording ORDER BY start_ms) AS rn FROM pieces),
pb AS (SELECT *, 0::BIGINT AS number, start_ms AS first FROM po WHERE rn = 1
 UNION ALL SELECT l.*, s.number + (s.end_ms - s.first >= 30000)::INT, CASE WHEN s.end_ms - s.first >= 30000 THEN l.start_ms ELSE s.first END FROM pb s JOIN po l ON l.recording = s.recording AND l.rn = s.rn + 1)
SELECT recording, number, seq FROM pb QUALIFY arg_max(end_ms, rn) OVER (PARTITION BY recording, number) - min(first) OVER (PARTITION BY recording, number) >= 30000""", "pieces").replace("\n, po AS", ",\npo AS").replace("WITH ", "WITH RECURSIVE ", 1),
    "t6_settled_marks": sql(MARKS, "pieces").replace("\n, m AS", ",\nm AS"),
    "t5_voice_stream": f"WITH RECURSIVE {PLACED} SELECT recording, window_ix, track, speaker, voice, round(score, 6) AS score FROM pl",
    "t5_live_voices": f"WITH RECURSIVE {PLACED} SELECT recording, window_ix, track, speaker, voice, round(score, 6) AS score FROM pl",
    "t12_latest_voices": f"WITH RECURSIVE {PLACED} SELECT recording, voice, max(window_ix) AS window_ix FROM pl GROUP BY ALL",
    "t12_voice_snapshot": f"""WITH RECURSIVE {PLACED},
{VIEWS["members"]}, {VIEWS["voices"]},
fin AS (SELECT recording, unnest(vs) AS x, unnest(range(1, len(vs) + 1)) AS i FROM pl QUALIFY row_number() OVER (PARTITION BY recording ORDER BY rn DESC) = 1),
ms AS (SELECT recording, i, x, name, list_cosine_similarity(x.total, centroid) AS score FROM fin, voices)
SELECT recording, 'S' || i AS voice, x.track AS track, x.last AS window_ix, round(x.seconds, 3) AS seconds, name AS match, round(score, 6) AS score FROM ms QUALIFY row_number() OVER (PARTITION BY recording, i ORDER BY score DESC, name) = 1""",
    "j14_relabelled_lines": sql(f""", l AS (SELECT recording, seq AS line_ix, voice, {P} AS part FROM pieces),
a AS (SELECT l.*, CASE WHEN voice = 'user' AND recording % 2 = 0 THEN 'Ann' END AS n1,
 CASE WHEN voice = 'user' AND recording % 5 = 0 THEN 'Mira' WHEN voice = 'user' AND recording % 2 = 0 THEN 'Ann' WHEN voice = 'assistant' AND recording % 3 = 0 THEN 'Piet' END AS n2 FROM l)
SELECT recording, line_ix, coalesce(n2, voice) AS display, 1 + (part < 1 AND n1 IS NOT NULL)::BIGINT + (part < 2 AND n2 IS DISTINCT FROM n1)::BIGINT AS n_shown FROM a""", "pieces").replace("\n, l AS", ",\nl AS"),
}
