"""Queries over the log of decisions on names, against a plain fold of its entries."""

import duckdb
import pytest

from talkspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def last():
    """(number of entries, the last one's number and name) of each speaker of a job."""
    out = {}
    for job, seq, speaker in duckdb.sql(f"SELECT user_id, event_id, event_type FROM '{SF}/events.parquet' ORDER BY event_id").fetchall():
        out[job, speaker] = out.get((job, speaker), (0,))[0] + 1, seq, None if seq % 10 == 0 else f"P{seq % 13}"
    return out


def names(last):
    """Speakers by name of each job."""
    out = {}
    for (job, speaker), (_, _, name) in sorted(last.items()):
        if name:
            out.setdefault(job, {}).setdefault(name, []).append(speaker)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_split_people_read_the_log_of_names(spark, last):
    want = [(job, name, len(who), ",".join(who)) for job, x in names(last).items() for name, who in x.items() if len(who) > 1]
    assert want and rows(registry.a9(spark, SF)) == sorted(want)


def test_renamed_voices_read_the_log_of_names(spark, last):
    want = [(job, speaker, "P4" if name == "P3" else name) for (job, speaker), (_, _, name) in last.items() if name and "P3" in names(last)[job]]
    assert want and rows(registry.j18(spark, SF)) == sorted(want)


def test_current_labels_read_the_log_of_names(spark, last):
    want = [(*key, name) for key, (_, _, name) in last.items() if name]
    assert 0 < len(want) < len(last) and rows(registry.m5(spark, SF)) == sorted(want)


def test_set_removals_read_the_log_of_names(spark, last):
    want = [key for key, (_, seq, _) in last.items() if seq % 4 == 1]
    assert 0 < len(want) < len(last) and rows(registry.m7_set(spark, SF)) == sorted(want)


def test_toggled_removals_read_the_log_of_names(spark, last):
    want = [key for key, (n, _, _) in last.items() if n % 2]
    assert 0 < len(want) < len(last) and rows(registry.m7(spark, SF)) == sorted(want)
