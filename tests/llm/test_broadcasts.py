"""Tables that grow with the input are sides of shuffled joins, however small Spark takes them to be."""

import re

import pytest
from pyspark.sql import functions as F

from talkspark.llm import common, kn_quality, minhash_dedup
from tests.llm.test_llm import DOCS, near_copies


@pytest.fixture
def plans(monkeypatch):
    """(name, first plan) of what is stored meanwhile."""
    made = []

    def noted(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.stored(df, name)

    for module in (kn_quality, minhash_dedup):
        monkeypatch.setattr(module, "stored", noted)
    return made


def test_lists_of_coordinates_and_differences_are_not_broadcast(spark, plans):
    rows = near_copies(120, 7, vocab=120, most=0.16)
    minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    seen = [(name, plan) for name, plan in plans if name in ("prefixes", "lists", "rarest", "shingles")]
    assert {name for name, _ in seen} == {"prefixes", "lists", "rarest", "shingles"}
    assert not [name for name, plan in seen if "Broadcast" in plan]


def test_counts_of_blocks_and_long_grams_are_not_broadcast(spark, plans):
    docs = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en", "a", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    out = kn_quality.quality(spark.createDataFrame(docs, DOCS), labels)
    assert out.where("perplexity is not null").count() == 60
    plan = dict(plans)["scores"]
    sent = re.findall(r"BroadcastHashJoin \[fold#\d+, (\w+)#\d+L\]", plan)
    assert sent.count("gram") == 0 and sent.count("g") <= 2 and sent.count("c") <= 3  # 65,536 rows a fold at most


def test_many_groups_are_dealt_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 5)
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 20).alias("key"), "id")
    groups = common.cut(rows.groupBy("key").agg(F.count("*").alias("n")))
    out = common.with_groups(rows, groups, "key")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.key, r.n) for r in out.collect()) == [(i, f"k{i % 20}", 10) for i in range(200)]
