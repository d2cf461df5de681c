"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class for Spark SQL's Java regexes.
WHITE_CLASS, WORD_CLASS = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage: a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute df once and keep it as compressed Parquet in the shared folder; for wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back when a task ends."""
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that moves both sides, whatever Spark takes their sizes to be: it sizes a table by its compressed
    files, a list as one element and an explode as one row, and so would broadcast many times its limit from the driver."""
    return side.hint("merge")


#: Rows of a table that may be broadcast: a few numbers each.
FEW = 10_000
SALTS = 64


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows, each with the columns of its group (equal keys, never null): broadcast if groups are at most FEW, else
    salted, as one group may hold a third of all rows. groups has one row for each key and was computed before."""
    if groups.count() <= FEW:
        return rows.join(F.broadcast(groups), key)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(shuffled(copies), [key, "__salt"]).drop("__salt")


def words_of(text: Column) -> Column:
    """The words of a text, [^\\x20\\x09-\\x0D]+, as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), "")


def n_words_of(text: Column) -> Column:
    """Number of words as a long: every word and the white space after it become one character."""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.length(F.regexp_replace(begun, f"{WORD_CLASS}++{WHITE_CLASS}*+", "x")).cast("long")
