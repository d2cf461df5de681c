"""Scoring of transcript clean-up models."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Judge score that the fastest recommended model needs.
FAIR = 60


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, 0 to 1; null if one is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


#: Prompts that are broadcast.
FEW = 10_000


def grid(cases: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every case with every prompt of every model: prompts has a row (model, prompt_id) for each."""
    # a few models and prompts, given by hand; were they many, neither side would be held whole
    return cases.join(F.broadcast(prompts), F.lit(True)) if prompts.count() <= FEW else cases.crossJoin(prompts)


def model_summaries(results: DataFrame) -> DataFrame:
    """(model, prompt_id): counts and means over rows without an error; performance is the mean of what is there."""
    ok = F.col("error").isNull()
    mean = lambda c, also=None: F.avg(F.when(ok if also is None else ok & also, F.col(c)))
    judged = mean("llmaaj_score", F.coalesce(F.col("llmaaj_valid_case"), F.lit(True)))
    s = results.groupBy("model", "prompt_id").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), mean("quality_score").alias("quality"), mean("granularity_score").alias("granularity"),
        mean("quality_score", F.col("category") == "mixed_task").alias("mixed_quality"), judged.alias("judge"), mean("exact").alias("exact"),
        mean("elapsed_seconds").alias("seconds"), mean("chars_per_second").alias("chars_per_second"),
    )
    parts = F.filter(F.array(F.col("quality") * 100, F.col("granularity") * 100, F.col("judge")), lambda x: x.isNotNull())
    mean_of = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    return s.withColumn("performance", mean_of)


def ranked(summaries: DataFrame) -> DataFrame:
    """Judged models first, then by judge, performance and speed."""
    order = Window.orderBy(F.col("judge").isNull(), F.desc_nulls_last("judge"), F.desc_nulls_last("performance"), F.desc_nulls_last("chars_per_second"), "model", "prompt_id")
    return summaries.withColumn("place", F.row_number().over(order))


def best_prompts(results: DataFrame) -> DataFrame:
    """The best prompt of each model for mixed tasks and for others."""
    use = results.where("error is null").withColumn("use_case", F.when(F.col("category") == "mixed_task", "mixed").otherwise("plain"))
    s = use.groupBy("model", "use_case", "prompt_id").agg(*(F.avg(c).alias(c) for c in ("llmaaj_score", "quality_score", "granularity_score", "chars_per_second")))
    key = F.struct(*(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("llmaaj_score", "quality_score", "granularity_score", "chars_per_second")), (-F.col("prompt_id")).alias("p"))
    return s.groupBy("model", "use_case").agg(F.max_by("prompt_id", key).alias("prompt_id"), F.count("*").alias("n_prompts"))


def recommended(summaries: DataFrame) -> DataFrame:
    """The best overall, and the fastest whose judge score is FAIR or more."""
    order = F.struct(F.coalesce("judge", F.lit(-1.0)), F.coalesce("performance", F.lit(-1.0)), F.coalesce("chars_per_second", F.lit(-1.0)), (-F.col("model")).alias("m"), (-F.col("prompt_id")).alias("p"))
    speed = F.struct(F.coalesce("chars_per_second", F.lit(-1.0)), (-F.col("model")).alias("m"), (-F.col("prompt_id")).alias("p"))
    pick = lambda df, by, name: df.agg(F.max_by(F.struct("model", "prompt_id"), by).alias("b")).where("b is not null").select(F.lit(name).alias("pick"), "b.model", "b.prompt_id")
    return pick(summaries, order, "best").unionByName(pick(summaries.where(F.col("judge") >= FAIR), speed, "fastest"))


def test_set(results: DataFrame) -> DataFrame:
    """Cases and categories seen, and cases that the judge excludes."""
    return results.agg(
        F.countDistinct("case_id").alias("n_cases"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.countDistinct(F.when(~F.col("llmaaj_valid_case"), F.col("case_id"))).alias("n_excluded")
    )


def rule_judge(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge by rules: 0 for an empty output, 100 for an exact one, else 100 * ratio less the points of rules that fail.

    results: case_id, output, expected, ratio. rules: case_id, kind (must_have, must_not), fragment, points.
    """
    hit = F.contains(F.lower("output"), F.lower("fragment"))
    lost = F.when((F.col("kind") == "must_have") & ~hit, F.col("points")).when((F.col("kind") == "must_not") & hit, F.col("points")).otherwise(0)
    note = F.when(lost > 0, F.concat("kind", F.lit(":"), "fragment"))
    failed = results.select("row_id", "case_id", "output").join(rules, "case_id").groupBy("row_id").agg(F.sum(lost).alias("lost"), F.array_join(F.array_sort(F.collect_set(note)), ";").alias("notes"))
    out = results.join(failed, "row_id", "left")
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.col("ratio") - F.coalesce("lost", F.lit(0))))
    score = F.when(F.trim("output") == "", 0.0).when(F.col("output") == F.col("expected"), 100.0).otherwise(raw)
    return out.withColumns({"judge": score, "notes": F.coalesce("notes", F.lit(""))}).drop("lost")
