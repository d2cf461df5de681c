"""Streams of live meetings: restarts, timers in real time, state over batches; keys and orders without one task for a key."""

import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from talkspark.operators import live, places, roster, steps, voices
from talkspark.sources.shared import new_path
from talkspark.streaming import following, stateful
from talkspark.streaming.ledger import Ledger, follow

LINES = "recording bigint, track string, seq bigint, start_ms bigint, end_ms bigint, covered_ms bigint"


def lines_of(seed):
    r, out = random.Random(seed), []
    for rec in range(3):
        at = {"mic": 0, "system": 0}
        for q in range(40):
            t = r.choice(["mic", "system"])
            start = at[t] + r.randrange(0, 3000)
            at[t] = start + r.randrange(100, 4000)
            out.append((rec, t, q, start, at[t], at[t] + 100))
    return out


@pytest.mark.parametrize("where", ["lines", "pending", "covered", "log"])
def test_a_stopped_stream_goes_on_without_repeats_or_gaps(spark, where):
    rows = lines_of(1)
    source, ledger, broken = new_path(spark, "src"), Ledger(spark, new_path(spark, "ledger")), []

    def crash(batch, at):
        if batch == 1 and at == where and not broken:
            broken.append(at)
            raise RuntimeError("power is gone")

    for k in range(3):
        spark.createDataFrame([x for x in rows if x[2] // 14 == k], LINES).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LINES).parquet(source)
        try:
            follow(stream, ledger, following.release_step, crash)
        except StreamingQueryException:
            assert k == 1
            # what is half written isn't seen
            assert ledger.last() == 0 and {r.batch for r in ledger.read("lines", following.LINE).select("batch").distinct().collect()} <= {0}
            follow(spark.readStream.schema(LINES).parquet(source), ledger, following.release_step, crash)
    assert broken
    got = [tuple(r) for r in ledger.read("lines", following.LINE).select("recording", "seq").collect()]
    level = {rec: min(max(c for x, t, *_, c in rows if x == rec and t == track) for track in ("mic", "system")) for rec in range(3)}
    assert sorted(got) == sorted((x[0], x[2]) for x in rows if x[3] < level[x[0]])
    waits = {(r.recording, r.track): r.n_pending for r in following.progress(ledger).collect()}
    assert sum(waits.values()) == len(rows) - len(got)


def test_idle_tracks_follow(spark):
    """Row by row against a slow walk over all rows, whatever the batches."""
    r, rows, now = random.Random(2), [], 0
    for q in range(60):
        now += r.choice([200, 700, 2500])
        rows.append(("mic" if r.random() < 0.8 else "system", q, now - 150, now - 50, now))
    c, want, waiting = stateful.Covers(began=rows[0][4]), {}, []
    for track, q, start, cover, heard in rows:
        waiting.append((q, start))
        c.row(track, cover, heard)
        c.follow_idle(heard, ("mic", "system"))
        for w in [w for w in waiting if w[1] < c.level(("mic", "system"))]:
            want[w[0]] = q
            waiting.remove(w)
    source, out, checkpoint = new_path(spark, "idle"), new_path(spark, "idle-out"), new_path(spark, "idle-state")
    schema = LINES + ", heard_ms bigint"
    for k in range(2):
        part = [(1, t, q, s, s + 50, cv, h) for t, q, s, cv, h in rows if q // 31 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        with stateful.typed_state(spark):
            made = stateful.released_with_idle(spark.readStream.schema(schema).parquet(source))
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
    got = {x.seq: x.released_at for x in spark.read.parquet(out).collect()}
    assert got == want


def test_a_silent_track_lets_lines_go_in_real_time(spark):
    """The system track was heard once and is silent: a processing-time timer moves its cover, without any new row."""
    source, out, schema = new_path(spark, "silent"), [], LINES + ", heard_ms bigint"
    now = int(time.time() * 1000)
    rows = [(1, "system", 0, 0, 50, 100, now - 1200), (1, "mic", 1, 5000, 5500, 9000, now + 4000)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    with stateful.typed_state(spark):
        made = stateful.released_with_idle(spark.readStream.schema(schema).parquet(source))
        q = made.writeStream.foreachBatch(lambda b, n: out.extend(r.seq for r in b.collect())).option("checkpointLocation", new_path(spark, "silent-state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while sorted(out) != [0, 1] and time.time() < until:
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(out) == [0, 1]


def test_marks_settle_or_run_out():
    windows = [(1000, None, 7, 0), (3000, "a", 0, 3000), (6500, "b", 800, 1600), (9000, None, 8, 0), (30_000, "a", 29_000, 30_000), (31_000, None, 9, 0)]
    done, waiting = stateful.after_rows([], windows)
    # 7: by 6 s a was heard 1.5 s and b 0.7 s; 8: nobody until its time ran out
    assert done == [(7, "named", "a"), (8, "nobody", None)] and [m.mark for m in waiting] == [9]
    assert stateful.settle(waiting, 45_999, True)[0] == [] and stateful.settle(waiting, 46_000, True)[0] == [(9, "nobody", None)]


def test_voices_go_on_from_state():
    r = random.Random(4)
    rows = [(w, t, s, [r.gauss(0, 1) for _ in range(6)], r.uniform(1, 20), r.uniform(0, 5)) for w in range(12) for t in ("mic", "system") for s in "abc"]
    whole, voices_held, parts = list(live.each_placed_voice(rows)), [], []
    for k in range(0, len(rows), 18):
        parts += live.each_placed_voice(rows[k : k + 18], voices=voices_held)
    assert [x[:4] for x in parts] == [x[:4] for x in whole]


def test_sections_cut_inside_a_batch(spark):
    rows = [(1, b, 10_000 * (5 * b + i), 10_000 * (5 * b + i) + 9_000, 5 * b + i) for b in range(4) for i in range(5)]
    made, after = live.sections(
        spark.createDataFrame(rows, "recording bigint, batch bigint, start_ms bigint, end_ms bigint, line bigint"),
        spark.createDataFrame([(1, 0, 900, 3), (1, 1, 100, 1), (1, 2, 900, 3), (1, 3, 0, 0)], "recording bigint, batch bigint, p_milli bigint, first_new bigint"),
    )
    assert [r.section for r in made.orderBy("line").collect()] == [0] * 13 + [1] * 7
    assert [tuple(r) for r in after.collect()] == [(1, 1, 130_000, 199_000)]


# ---- keys and places ---------------------------------------------------------------------------------------------


def slow_keys(names):
    taken, out = set(), {}
    for seq, slug in sorted(names):
        options = [slug or "persona"]
        while options[-1] in taken:
            options.append(f"{options[0]}-{len(options) + 1}")
        taken.add(options[-1])
        out[seq] = options[-1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_keys_equal_a_walk(spark, seed):
    r = random.Random(seed)
    slugs = ["x", "x-2", "x-3", "x-2-2", "x-2-3", "x-1", "x-02", "", "persona-2", "y", "y-2", "x-4", "x-5", "x-2-2-2", "2"]
    names = [(q, r.choices(slugs, weights=[8, *[1] * 14])[0]) for q in range(r.choice([20, 120]))]
    made = roster.unique_keys(spark.createDataFrame(names, "seq bigint, slug string"))
    assert {x.seq: x.key for x in made.collect()} == slow_keys(names)


def test_no_task_numbers_a_whole_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be joined
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    made = places.numbered_within(rows, ["k"], [F.col("seq").desc()], "n")
    assert made.where("n <> 40000 - seq").count() == 0
    most = made.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most <= 0.8 * 40_000  # four partitions by hash


def test_deleted_voices_stay_deleted(spark):
    log = [(1, "fold", "n", "Ann", 1, "S0", [1.0, 0.0], 1.0), (2, "fold", "n", "Ann", 2, "S0", [0.0, 1.0], 1.0), (3, "unfold", "n", "Ann", 2, "S0", None, None), (4, "delete", "n", "Ben", None, None, None, None), (3, "fold", "n", "Ben", 5, "S1", [1.0, 1.0], 1.0), (5, "fold", "n", "Ben", 6, "S1", [1.0, 1.0], 1.0)]
    frame = lambda x: spark.createDataFrame(x, "seq bigint, op string, namespace string, name string, job_id bigint, speaker_id string, embedding array<double>, weight double")
    once = sorted((r.name, r.job_id) for r in voices.members_after(frame(log)).collect())
    assert once == [("Ann", 1), ("Ben", 6)]
    assert sorted((r.name, r.job_id) for r in voices.members_after(frame(log + log[:3] + log[4:5])).collect()) == once


def test_sums_follow_members(spark):
    r = random.Random(6)
    rows = [("n", f"v{k % 4}", k, "S0", [r.gauss(0, 1) for _ in range(5)], r.uniform(0.5, 2)) for k in range(40)]
    frame = lambda x: spark.createDataFrame(x, "namespace string, name string, job_id bigint, speaker_id string, embedding array<double>, weight double")
    gone, new = [x for x in rows if x[2] % 3 == 0 and x[1] in ("v0", "v1") or x[1] == "v2"], [("n", "v9", 99, "S0", [1.0, 0.0, 0.0, 0.0, 0.0], 1.0)]
    made = voices.centroids_of(voices.changed_sums(voices.print_sums(frame(rows)), frame(gone), frame(new)))
    want = voices.centroids(frame([x for x in rows if x not in gone] + new))
    a, b = ({x.name: x.centroid for x in df.collect()} for df in (made, want))
    assert set(a) == set(b) == {"v0", "v1", "v3", "v9"} and all(a[k] == pytest.approx(b[k]) for k in a)


def test_relabelled_lines_come_again(spark):
    ledger, source = Ledger(spark, new_path(spark, "names")), new_path(spark, "spoken")
    names = [[], [(1, "S1", "Ann")], [(1, "S1", "Anna"), (1, "S2", "Ben")]]
    for k in range(3):
        spark.createDataFrame([(1, 10 * k + i, f"S{i}") for i in (1, 2)], following.SPOKEN).write.mode("append").parquet(source)
        now = spark.createDataFrame(names[k], "recording bigint, voice string, name string")
        follow(spark.readStream.schema(following.SPOKEN).parquet(source), ledger, lambda b, log, now=now: following.relabel_step(b, log, now))
    got = {r.line_ix: (r.display, r.n_shown) for r in following.displayed(ledger).collect()}
    assert got == {1: ("Anna", 3), 2: ("Ben", 2), 11: ("Anna", 2), 12: ("Ben", 2), 21: ("Anna", 1), 22: ("Ben", 1)}


@pytest.mark.parametrize("after", [True, False])
def test_ranges_of_runs_equal_one_walk(after):
    for seed in range(300):
        r = random.Random(seed)
        n, reach = r.randrange(1, 40), r.randrange(1, 60)
        starts = sorted(r.randrange(0, 200) for _ in range(n))
        lines = [(s, s + r.randrange(0, 50)) for s in starts]
        if seed % 5 == 0:
            lines += [(r.choice([200, None]), None), (None, 300)]
        want = list(steps.walk(lines, reach, after))
        cuts = sorted(r.sample(range(1, len(lines)), min(len(lines) - 1, r.randrange(0, 5)))) if len(lines) > 1 else []
        number, first, got = 0, None, []
        for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
            got += steps.walk(lines[a:b], reach, after, number, first)
            own = steps.Range(lines[a:b], reach, after)
            if first is None:
                c, first = own.left[0]
                number += c
            else:
                e = next((x for x in own.entries() if first <= x[0]), None)
                if e:
                    number, first = number + e[1], e[2]
        assert got == want, (seed, lines, reach, cuts)
    if after:
        some = [(0, 5), (5, 31), (32, 40), (41, 70)]
        assert list(steps.walk(some, 30, True)) == live.step_batches(some, 30)


def test_runs_of_a_hot_recording(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(3)
    rows = [(rec, 40 * k + r.randrange(0, 40), k) for rec, n in ((1, 3000), (2, 50), (None, 30)) for k in range(n)]
    rows = [(rec, s, s + r.randrange(0, 90), k) for rec, s, k in rows]
    made = steps.runs(spark.createDataFrame(rows, "recording bigint, start_ms bigint, end_ms bigint, id bigint"), ["recording"], ["start_ms", "id"], 500, "batch")
    got = {(x.recording, x.id): x.batch for x in made.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for rec in (1, 2, None):
        own = sorted((s, k, e) for c, s, e, k in rows if c == rec)
        assert [got[(rec, k)] for _, k, _ in own] == list(steps.walk([(s, e) for s, _, e in own], 500, True))


def test_a_quiet_meeting_grows_stale(spark):
    source, out, schema = new_path(spark, "quiet"), [], "recording bigint, seq bigint, start_ms bigint, end_ms bigint"
    spark.createDataFrame([(1, 1, 0, 4000), (1, 2, 5000, 31_000), (1, 3, 32_000, 33_000)], schema).coalesce(1).write.parquet(source)
    with stateful.typed_state(spark):
        made = stateful.step_batches(spark.readStream.schema(schema).parquet(source), stale=1500)
        q = made.writeStream.foreachBatch(lambda b, n: out.extend((r.number, r.seq) for r in b.collect())).option("checkpointLocation", new_path(spark, "quiet-state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while len(out) < 3 and time.time() < until:
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(out) == [(0, 1), (0, 2), (1, 3)]
