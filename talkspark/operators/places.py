"""Places of rows in an order, without one task for a key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.sources.shared import new_path


#: Rows that one task of a dealt shuffle gets.
TASK_ROWS = 250_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions that rows are dealt over: as many as keep one task's rows the same however many there are, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows in parts by keys; without parts as the next step deals them.

    Spark sizes a step's partitions by the bytes that were shuffled. Those tell little of what a task then holds where texts become
    words, and words, which are packed into a few bytes each, are sorted.
    """
    return rows if parts is None else rows.repartition(parts, *keys)


def in_ranges(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows sorted into ranges of (keys, order), with the range's number; kept, as ranges may be drawn otherwise the next time.

    A key with a third of all rows has a third of the ranges.
    """
    path = new_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())])).parquet(path)


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number (from 1) in the order of their key.

    A row's number is its number within its range (in_ranges) and what the key has in earlier ones: only a count for each
    key and range goes through the window over keys.
    """
    part, base, own = (f"__{c}_{uuid.uuid4().hex[:8]}" for c in ("part", "base", "own"))
    kept = in_ranges(rows, keys, order, part)
    counts = kept.groupBy(*keys, part).agg(F.count("*").alias(own))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(part).alias(f"_{part}"), F.coalesce(F.sum(own).over(before), F.lit(0)).alias(base))
    here = kept.withColumn(own, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(part) == F.col(f"_{part}")]
    joined = here.join(bases, same)
    return joined.select(*rows.columns, (F.col(base) + F.col(own)).alias(name))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Compute rows once and keep them in the shared folder."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Copies of a key's row in spread_join, and how many rows may be broadcast instead.
SALTS, FEW = 64, 10_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, which has one row for each key: rows of one key are spread over SALTS tasks, unless facts
    are few enough to be broadcast."""
    facts = stored(facts, "facts")
    if facts.count() <= FEW:
        return rows.join(F.broadcast(facts), key)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(copies, [key, "__salt"]).drop("__salt")
