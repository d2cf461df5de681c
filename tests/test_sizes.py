"""What a task gets doesn't grow with the tables."""

import random

import pytest
from pyspark.sql import functions as F

from talkspark.operators import lines, places
from talkspark.plans import following, registry, stores, transcripts, views

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks of 100 rows, so that small tables need many."""
    monkeypatch.setattr(places, "TASK_ROWS", 100)


def test_lines_are_dealt_by_their_words(spark, small_tasks, monkeypatch):
    n = views.words(spark, SF).count()
    made = transcripts.made_lines(spark, SF)
    assert made.rdd.getNumPartitions() >= n // 100
    few = rows(made)
    monkeypatch.setattr(places, "TASK_ROWS", 10**9)
    assert few == rows(transcripts.made_lines(spark, SF))


def test_words_are_not_broadcast(spark):
    """Their files are far smaller than they are, so that Spark's estimate would have them broadcast."""
    plan = views.spoken(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_release_stream_has_no_call_for_each_recording(spark, monkeypatch):
    from talkspark.streaming import stateful

    def call(*_):
        raise AssertionError("a call for each recording")

    monkeypatch.setattr(stateful, "released_stream", call)
    events = views.table(spark, SF, "events")
    assert 0 < stores.t1_stream(spark, SF).count() < events.count()


def test_turns_of_orders_are_dealt(spark, small_tasks):
    turns = views.big_turns(spark, SF)
    assert turns.rdd.getNumPartitions() >= turns.count() // 100
    assert registry.w10(spark, SF).rdd.getNumPartitions() >= turns.count() // 100


def test_sample_decisions_are_dealt(spark, small_tasks, monkeypatch):
    decided, problems = registry.decisions(spark, SF)
    n = decided.count()
    assert decided.rdd.getNumPartitions() >= n // 100
    few = rows(decided), rows(problems)
    monkeypatch.setattr(places, "TASK_ROWS", 10**9)
    assert few == tuple(map(rows, registry.decisions(spark, SF)))


def test_pieces_are_dealt_by_their_rows(spark, small_tasks, monkeypatch):
    seen, plain = [], lines.split_words
    monkeypatch.setattr(lines, "split_words", lambda *a, parts=None, **k: seen.append(parts) or plain(*a, parts=parts, **k))
    assert following.t13(spark, SF).count() == transcripts.w3(spark, SF).count()
    n = views.words(spark, SF).count()
    assert sum(seen[: following.PARTS]) >= n // 100


def test_fed_rows_are_made_once(spark, monkeypatch, tmp_path):
    """Rows that fall into other parts each time they are made are fed once all the same."""
    monkeypatch.setattr(following, "new_path", lambda *_: str(tmp_path / "fed"))
    any_part = F.udf(lambda: random.SystemRandom().randrange(following.PARTS), "int").asNondeterministic()
    following.fed(spark, spark.range(300), any_part(), lambda stream, k: None)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "fed")).collect()) == list(range(300))
