"""Hooks for models that users bring: vectorized functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions.scalars import reply_json

ASR = "job_id string, chunk_ix int, text string, start double, end double, words array<struct<word:string,start:double,end:double>>"
TURNS = "job_id string, speaker string, start double, end double"


def transcribe(audio: DataFrame, engine: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Segments of audio rows. engine() loads a model once for each task; what it gives turns a batch into ASR rows."""
    return _per_batch(audio, engine, ASR)


def diarize(audio: DataFrame, engine: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Turns of audio rows, any number for each."""
    return _per_batch(audio, engine, TURNS)


def _per_batch(rows: DataFrame, engine: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = engine()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def asked(questions: DataFrame, engine: Callable[[], Callable[[pd.Series], pd.Series]], column: str = "prompt") -> DataFrame:
    """questions with reply: the model's answer to each prompt."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = engine()
        for batch in batches:
            yield model(batch)

    return questions.withColumn("reply", F.pandas_udf(run, T.StringType())(F.col(column)))


def probability(reply: str = "reply") -> Column:
    """The probability in a reply such as {"p": 0.8}; 0 to 1, null if there is none."""
    p = reply_json(F.col(reply), "p double")["p"]
    return F.when((p >= 0) & (p <= 1), p)
