"""Hand-made cases and slow twins."""

import random

import pytest
from pyspark.sql import functions as F

from talkspark.functions import scalars
from talkspark.operators import attribution, chunks, lines, live, roster, samples, voices
from talkspark.streaming import stateful


def words(spark, rows, job=1):
    return spark.createDataFrame([(job, c, i, w, s, e) for i, (c, w, s, e) in enumerate(rows)], "job_id bigint, chunk_ix bigint, pos bigint, word string, start_ms bigint, end_ms bigint")


def turns(spark, rows, job=1):
    return spark.createDataFrame([(job, i, *r) for i, r in enumerate(rows)], "job_id bigint, turn_ix int, speaker string, start_ms bigint, end_ms bigint")


def said(spark, w, t):
    s = attribution.segments(attribution.attributed(words(spark, w), turns(spark, t)))
    return [(r.speaker, r.text, r.speaker_confidence) for r in s.orderBy("chunk_ix", "seg_ix").collect()]


def test_word_between_turns_is_unknown(spark):
    w = [(0, "open", 2100, 2500), (0, "hm", 4000, 4700), (0, "later", 6200, 6900)]
    assert said(spark, w, [("K1", 2000, 3200), ("K2", 6000, 9000)]) == [("K1", "open", 1.0), ("UNKNOWN", "hm", 0.0), ("K2", "later", 1.0)]


def test_short_turn_inside_fluent_words_is_ignored(spark):
    w = [(0, x, 250 * i, 250 * i + 240) for i, x in enumerate("so we start with the budget now".split())]
    assert said(spark, w, [("K2", 0, 700), ("K1", 700, 830), ("K2", 830, 4000)]) == [("K2", "so we start with the budget now", 1.0)]


def test_pause_lets_the_next_speaker_begin(spark):
    w = [(0, "kom", 0, 300), (0, "mee", 1400, 1600), (0, "naar", 1650, 1900)]
    assert [x[:2] for x in said(spark, w, [("K1", 0, 1000), ("K2", 1000, 3000)])] == [("K1", "kom"), ("K2", "mee naar")]


def test_ties_go_to_the_first_turn(spark):
    assert said(spark, [(0, "x", 0, 100)], [("B", 0, 50), ("A", 50, 100)])[0][0] == "B"


def test_span_goes_to_who_shares_most_of_it(spark):
    spans = spark.createDataFrame([(1, 4, 500, 2500), (1, 9, 30_000, 31_500)], "job_id bigint, span_ix bigint, start_ms bigint, end_ms bigint")
    out = {r.span_ix: (r.speaker, r.speaker_confidence) for r in attribution.dominant(spans, turns(spark, [("K2", 0, 1000), ("K1", 900, 2500)])).collect()}
    assert out == {4: ("K1", 0.8), 9: ("UNKNOWN", 0.0)}


def test_tokens(spark):
    t = spark.createDataFrame([(1, 0, [" zo", "n", " mooi", "e", " dag"], [50, 90, 300, 420, 700], [None] * 5), (1, 1, [], [], None)], "job_id bigint, chunk_ix bigint, tokens array<string>, starts array<bigint>, durations array<bigint>")
    assert [r.word for r in attribution.tokens_to_words(t).orderBy("pos").collect()] == ["zon", "mooie", "dag"]


def split(spark, rows):
    df = spark.createDataFrame([(1, s, sp, None, i, w, a, b) for i, (s, sp, w, a, b) in enumerate(rows)], "job_id bigint, seg_no bigint, speaker string, label string, pos bigint, word string, start_ms bigint, end_ms bigint")
    return [(r.speaker, r.text) for r in lines.lines(lines.split_words(df)).orderBy("line_no").collect()]


def test_lines_split_at_sentences_and_long_silence(spark):
    assert split(spark, [(0, "K", "Goed", 0, 200), (0, "K", "zo.", 250, 500), (0, "K", "En", 600, 700), (0, "K", "nu", 750, 900), (0, "K", "verder.", 950, 1300)]) == [("K", "Goed zo."), ("K", "En nu verder.")]
    steady = [(0, "K", f"s{i}", 500 * i, 500 * i + 420) for i in range(11)]
    assert [t.split()[0] for _, t in split(spark, [*steady, (0, "K", "eindelijk", 21_000, 21_600)])] == ["s0", "eindelijk"]


def test_speaker_change_forgets_gaps(spark):
    first = [(0, "A", f"a{i}", 400 * i, 400 * i + 300) for i in range(8)]
    other = [(1, "B", "b0", 4000, 4100), (1, "B", "b1", 4800, 4900)]
    assert [t for _, t in split(spark, [*first, *other])][-1] == "b0 b1"


def test_prorated_sentences(spark):
    s = spark.createDataFrame([(1, 0, "K", 4000, 12_000, "Klaar. Wie begint er? Ik.")], "job_id bigint, seg_no bigint, speaker string, start_ms bigint, end_ms bigint, text string")
    out = lines.sentence_lines(s).orderBy("part").collect()
    assert [r.text for r in out] == ["Klaar.", "Wie begint er?", "Ik."] and out[0].line_start == 4000 and out[-1].line_end == 12_000
    assert all(a.line_end <= b.line_start + 1 for a, b in zip(out, out[1:]))


def test_removal_leaves_other_lines(spark):
    made = spark.createDataFrame([(1, 0, "A", 0), (1, 1, "B", 500), (1, 2, "A", 900)], "job_id bigint, line_no bigint, speaker string, start_ms bigint")
    out = lines.without_removed(made, made.select("job_id", "speaker").where("speaker = 'B'"), spark.createDataFrame([(1, "A", 900)], "job_id bigint, speaker string, start_ms bigint"))
    assert [r.line_no for r in out.collect()] == [0]


def test_overlapping_chunks_keep_each_word_once(spark):
    rows = [(0, f"w{i}", 1000 * i, 1000 * i + 500) for i in range(10)] + [(1, f"g{i}", 1000 * i, 1000 * i + 500) for i in range(8, 14)]
    c = spark.createDataFrame([(1, 0, "", 0, 10_000), (1, 1, "", 8000, 14_000)], "job_id bigint, chunk_ix bigint, text string, start_ms bigint, end_ms bigint")
    out, kept = attribution.without_overlap(c, words(spark, rows))
    assert [r.word for r in kept.orderBy("start_ms").collect()] == [f"w{i}" for i in range(10)] + [f"g{i}" for i in range(10, 14)]
    assert {r.chunk_ix: r.start_ms for r in out.collect()} == {0: 0, 1: 10_000}


@pytest.mark.parametrize("seed", range(30))
def test_chunk_plan_covers(seed):
    r = random.Random(seed)
    t = [(a, a + r.randint(100, 200_000)) for a in (r.randint(0, 500_000) for _ in range(r.randint(0, 30)))]
    duration = r.randint(1, 600_000)
    plan = chunks.plan_chunks(t, duration)
    assert plan[0][0] == 0 and plan[-1][1] == duration
    assert all(b - a <= 90_000 and b > a for a, b in plan)
    assert all(x[1] >= y[0] >= x[0] for x, y in zip(plan, plan[1:]))


def test_chunks_overlap_where_a_turn_ends():
    assert chunks.plan_chunks([(4000, 60_000), (60_000, 95_500)], 97_000) == [(0, 4000), (4000, 60_000), (58_000, 95_500), (93_500, 97_000)]
    assert chunks.plan_chunks([], 100_000) == [(0, 90_000), (88_000, 100_000)] and chunks.plan_chunks([], 0) == []


def test_keys_are_free(spark):
    df = spark.createDataFrame(list(enumerate(["x", "x", "x-2", "y", "x", "", "x-2"])), "seq bigint, slug string")
    assert [r.key for r in roster.unique_keys(df).orderBy("seq").collect()] == ["x", "x-2", "x-2-2", "y", "x-3", "persona", "x-2-3"]


def test_voices_fold_and_unfold(spark):
    schema = "namespace string, name string, job_id bigint, speaker_id string, embedding array<double>, weight double, added bigint"
    m = spark.createDataFrame([("n", "Ann", 1, "S0", [4.5, 0.0], 1.0, 1)], schema)
    new = spark.createDataFrame([("n", "Ann", 1, "S0", [0.0, 2.0], 1.0, 2), ("n", " ", 2, "S0", [1.0, 0.0], 1.0, 3), ("n", "Bob", None, None, [1.0, 1.0], 4.0, 4)], schema)
    out = voices.folded(m, new)
    assert sorted((r.name, r.added) for r in out.collect()) == [("Ann", 2), ("Bob", 4)]
    left = voices.unfolded(out, spark.createDataFrame([("n", "Ann", 1, "S0")], "namespace string, name string, job_id bigint, speaker_id string"))
    assert [r.name for r in left.collect()] == ["Bob"]
    c = {r.name: r.centroid for r in voices.centroids(out).collect()}
    assert c["Ann"] == [0.0, 1.0] and abs(c["Bob"][0] - 0.5**0.5) < 1e-12


def test_best_voice(spark):
    v = spark.createDataFrame([("n", "Mira", [0.6, 0.8]), ("n", "Piet", [0.6, 0.8]), ("m", "Sam", [0.0, 1.0])], "namespace string, name string, centroid array<double>")
    p = spark.createDataFrame([("n", 1, [0.0, 1.0]), ("n", 2, [1.0, 1.0, 1.0]), ("n", 3, [-1.0, 0.0])], "namespace string, print_id bigint, embedding array<double>")
    out = {r.print_id: (r.name, r.score and round(r.score, 3), r.resolved) for r in voices.resolved(voices.best_voice(p, v)).collect()}
    assert out[1] == ("Mira", 0.8, "Mira") and out[2] == (None, None, None) and out[3][2] is None


def test_widths_must_agree(spark):
    schema = "namespace string, name string, job_id bigint, speaker_id string, embedding array<double>, weight double, added bigint"
    bad = spark.createDataFrame([("n", "A", 1, "S", [1.0, 0.0], 1.0, 1), ("n", "A", 2, "S", [1.0, 0.0, 0.0, 0.0], 1.0, 2)], schema)
    with pytest.raises(Exception, match="widths differ"):
        voices.centroids(bad).collect()


def test_collapse_channel(spark):
    t = turns(spark, [("L_a", 0, 3000), ("L_b", 4000, 5000), ("R_a", 100, 900)])
    p = spark.createDataFrame([(1, "L_a", [0.0, 1.0]), (1, "L_b", [1.0, 0.0]), (1, "R_a", [3.0, 3.0])], "job_id bigint, speaker string, embedding array<double>")
    new, prints = voices.collapsed_channel(t, p, "L_")
    assert sorted((r.speaker, r.start_ms, r.end_ms) for r in new.collect()) == [("L_a", 0, 3000), ("L_a", 4000, 5000), ("R_a", 100, 900)]
    assert {r.speaker: r.embedding for r in prints.collect()} == {"L_a": [0.25, 0.75], "R_a": [3.0, 3.0]}


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ([(5, 8), (20, 33), (50, 58), (70, 76)], [(20, 30), (50, 58), (70, 76)]),
        ([(0, 2), (5, 6), (9, 12)], [(0, 2), (5, 6), (9, 12)]),
        ([(3, 40)], [(3, 13)]),
    ],
)
def test_montage(spark, given, wanted):
    out = samples.montage(turns(spark, [("K", a * 1000, b * 1000) for a, b in given]))
    assert [(r.start_ms // 1000, r.end_ms // 1000) for r in out.orderBy("take_no").collect()] == wanted


def test_items_fold():
    model = lambda **u: {"op": "set", **u}
    user = lambda **u: {"op": "set", "actor": "user", **u}
    items = live.fold_items([
        model(kind="decision", text="rent the hall", owner="Mira", due="May"), model(kind="todo", id="T9", text="call"), model(id="D1", text="rent both halls", owner=" "), user(id="D1", owner=""),
        model(id="D1", text="no hall"), model(op="delete", id="T1"), user(op="delete", id="T1"), user(id="T1", text="again"), model(kind="todo", id="T1", text="call again"), model(kind="todo", text="write"), user(id="D1", text=" "), model(kind="idea", text="x"), user(kind="todo", text="mine"),
    ])
    assert [(k, x["text"], x["owner"], x["due"], x["deleted"]) for k, x in items.items()] == [("D1", "rent both halls", "", "May", False), ("T1", "call", "", "", True), ("T2", "write", "", "", False)]


def test_steps_and_sections():
    assert live.step_batches([(0, 5), (5, 31), (32, 40), (41, 70)], 30) == [0, 0, 1, 1]
    batches = [(0, 30, 0, 900), (30, 61, 40, 900), (70, 95, 80, 900), (95, 120, 100, 900), (120, 2000, 120, 0), (2000, 2010, 2005, 900), (2010, 2030, 2010, 0)]
    assert list(live.each_batch_section(batches, 1000, 60, 600)) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 2)]
    at = live.OpenSection()
    assert [next(live.each_batch_section([b], 1000, 60, 600, at)) for b in batches] == list(live.each_batch_section(batches, 1000, 60, 600))


def test_live_voices():
    mira, piet = [0.0, 0.6, 0.8], [1.0, 0.0, 0.0]
    rows = [
        (0, "mic", "a", piet, 18.0, 18.0), (0, "mic", "b", mira, 14.0, 14.0), (1, "mic", "a", mira, 13.0, 6.0), (1, "mic", "b", piet, 11.0, 4.0),
        (2, "mic", "a", [0.9, 0.1, 0.3], 3.0, 3.0), (2, "system", "a", mira, 19.0, 19.0), (3, "mic", "a", [0.0, 0.0, 0.0], 8.0, 8.0),
    ]
    got = {(w, t, s): v for w, t, s, v, _ in live.place_voices(rows)}
    assert got[(0, "mic", "a")] == got[(1, "mic", "b")] == got[(2, "mic", "a")] == "S1" and got[(0, "mic", "b")] == got[(1, "mic", "a")] == "S2"
    assert got[(2, "system", "a")] == "S3" and got[(3, "mic", "a")] is None


def test_cover_of_both_tracks():
    c, both = stateful.Covers(), ("mic", "system")
    c.row("mic", 1000, 0)
    assert c.level(both) == -1
    c.row("system", 700, 100)
    assert c.level(both) == 700
    c.row("mic", 3000, 1590)
    c.follow_idle(1590, both)
    assert c.level(both) == 700
    c.row("mic", 3200, 1600)
    c.follow_idle(1600, both)
    assert c.level(both) == 2200
    c.follow_idle(9000, both)  # nobody grows: nothing moves
    assert c.level(both) == 2200


def test_scalars(spark):
    df = spark.createDataFrame([(" Ann ", "S0", 3_661_999), (" ", "S1", -5), (None, "S2", 90_000_000)], "label string, speaker string, ms bigint")
    out = df.select(scalars.display_name(F.col("label"), F.col("speaker")).alias("n"), scalars.clock(F.col("ms")).alias("c")).collect()
    assert [(r.n, r.c) for r in out] == [("Ann", "01:01:01"), ("S1", "00:00:00"), ("S2", "01:00:00")]


def test_reply(spark):
    df = spark.createDataFrame([('<think>x {"p": 1}</think> sure: ```json\n{"p": 0.25}\n```',), ("no",)], "r string")
    assert [r.p for r in df.select(scalars.reply_json(F.col("r"), "p double")["p"].alias("p")).collect()] == [0.25, None]


def test_reuse_takes_the_newest(spark):
    jobs = spark.createDataFrame([(1, 10, "f", True), (2, 20, "f", False), (3, 5, "g", True)], "job_id bigint, mtime bigint, fingerprint string, transcribed boolean")
    new = spark.createDataFrame([("a", "f"), ("b", "x")], "path string, fingerprint string")
    assert {r.path: r.reused_job for r in roster.reused(jobs, new).collect()} == {"a": 2, "b": None}
    assert {r.path: r.reused_job for r in roster.reused(jobs, new, True).collect()} == {"a": 1, "b": None}


@pytest.mark.parametrize("name", ["t2_step_batches", "t7_sections", "t5_live_voices", "m8_items", "w7_turn_chunks"])
def test_folds_hold_no_group(spark, name):
    from talkspark.plans import meetings, registry, stores, transcripts

    query = next(m.QUERIES[name] for m in (meetings, registry, stores, transcripts) if name in m.QUERIES)
    assert "InPandas" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_folds_give_rows_before_the_group_ends():
    import pyarrow as pa

    from talkspark.operators import live

    taken = []
    batches = (taken.append(k) or pa.RecordBatch.from_pydict({"key": [1] * 10, "at": [k] * 10}) for k in range(100))
    out = live.grouped(batches, 1, lambda key, rows: rows, pa.schema([("key", pa.int64()), ("at", pa.int64())]), 10)
    assert next(out).num_rows == 10 and len(taken) <= 2
    assert sum(b.num_rows for b in out) == 990


def test_backlog_pieces():
    rows = [(0, 40_000), (30_000, 90_000), (95_000, 125_000), (125_000, 130_000), (130_000, 400_000), (401_000, 402_000)]
    assert list(live.each_piece(rows)) == [0, 0, 1, 1, 2, 3]
    assert list(live.each_piece([])) == []


def test_growing_prints_and_suggestions(spark):
    rows = [("n", 1, "a", 0, 10, [2.0, 0.0], 1.0), ("n", 1, "a", 1, 11, [0.0, 5.0], 1.0), ("n", 1, "b", 0, 12, [0.0, 1.0], 3.0), ("n", 1, "c", 0, 13, [1.0, 0.0, 0.0], 1.0)]
    windows = spark.createDataFrame(rows, "namespace string, recording bigint, voice string, window_ix bigint, print_id bigint, embedding array<double>, weight double")
    grown = voices.growing_prints(windows)
    half = 0.5**0.5
    assert {r.print_id: [round(x, 9) for x in r.embedding] for r in grown.collect()} == {10: [1.0, 0.0], 11: [round(half, 9)] * 2, 12: [0.0, 1.0], 13: [1.0, 0.0, 0.0]}
    known = spark.createDataFrame([("n", "east", [1.0, 0.0]), ("n", "north", [0.0, 1.0])], "namespace string, name string, centroid array<double>")
    given = F.when(F.col("voice") == "b", "north")
    found = {r.print_id: (r.name, r.suggested) for r in voices.suggested(voices.best_voice(grown, known).withColumn("given", given)).collect()}
    assert found == {10: ("east", "east"), 11: ("east", None), 12: ("north", None), 13: (None, None)}


def test_orders(spark):
    files = spark.createDataFrame([("d", "d/b", 5), ("d", "d/a", 5), ("d", "d/.x", 1), ("d", "d/c", 2)], "dir string, path string, size bigint")
    assert [(r.path, r.place) for r in roster.smallest_first(files).orderBy("place").collect()] == [("d/c", 1), ("d/a", 2), ("d/b", 3)]
    items = spark.createDataFrame([(1, "T1", 9, False), (1, "T2", 3, True), (1, "D1", 4, False)], "session bigint, item string, at_ms bigint, deleted boolean")
    assert [(r["item"], r.place) for r in live.visible_items(items).orderBy("place").collect()] == [("D1", 1), ("T1", 2)]
    lines_in = spark.createDataFrame([(1, "mic", 1, 50, 60, 4), (1, "system", 2, 40, 70, 4), (1, "mic", 3, 10, 20, 5), (1, "mic", 4, 90, 95, None)], "recording bigint, track string, seq bigint, start_ms bigint, end_ms bigint, released_at bigint")
    assert [r.seq for r in live.release_order(lines_in).orderBy("place").collect()] == [2, 1, 3]
