"""Operator 7, mixing sources to target weights.

Systematic sampling: within a source every document expects target / source_size copies; the expected copies
are summed along the source in the order (size, salt, doc_id), one offset drawn for the source is added, and
a document is emitted once for each integer that its part of the sum crosses. Ordering by size spreads short
and long documents evenly, so a source's taken words stay within about one document of its target.

The place of a document in that order is found without gathering a source in one task: counts by (source,
size) and by (source, size, salt) are summed first, then only documents of one salt are numbered. The salt is
two hex digits of the MD5 of doc_id, so a group of equal sizes is split 256 ways; it also breaks ties, then doc_id and a
hash of the text do, and the offset is from the MD5 of the source, so reruns agree.

Defined results: a null text has size 0; null is a source of its own, ordered last; a null doc_id counts as
its own value, ordered first; repeated rows are documents of their own; a source without words has target 0
and takes nothing; other columns pass through, and an input column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.llm.common import n_words_of, stored

#: Weights that sources take in turn, and the most copies of any word of a source.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From counts n of each (source, size), per source (__none, __source): source_size, target, rate (expected copies of a document).

    Targets share all words by weight, none above `most` times its source. That is a water level: with
    sources in the order of most * size / weight, the level is the first mean of what remains that the next
    source can hold. Works on one row for each source.
    """
    every, ordered = Window.partitionBy(), Window.orderBy("__none", "__source")
    by_cap = Window.orderBy("__cap", "__place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("__none", "__source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    s = s.withColumn("__place", F.row_number().over(ordered))
    s = s.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__place") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", F.lit(float(most)) * F.col("source_size") / F.col("__weight"))
    left = (F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))).cast("double")
    open_weight = F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(before), F.lit(0))
    s = s.withColumn("__level", left / open_weight)
    first = F.min(F.when(F.col("__level") <= F.col("__cap"), F.struct("__cap", "__place", "__level"))).over(every)
    s = s.withColumn("__lambda", first["__level"])
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("__lambda") * F.col("__weight"))
    s = s.withColumn("target", F.coalesce(target, F.lit(0.0)))
    return s.select(
        "__none", "__source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def offset(source: Column, none: Column, seed: str = SEED) -> Column:
    """A source's random offset in [0, 1), a multiple of 2^-32 from an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.when(none, F.lit("-")).otherwise(F.lit("+")), source).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id", counted: bool = False) -> DataFrame:
    """docs (not yet repeated) with size, source_size, target, copies and taken = copies * size.

    counted: docs has no text but a size and a text_key, a hash of the text.
    """
    salt = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 2)
    made = {"__tie": F.col("text_key")} if counted else {"size": n_words_of(F.col(text)), "__tie": F.xxhash64(text)}
    rows = docs.withColumns({
        **made, "__none": F.col(source).isNull(),
        "__source": F.coalesce(F.col(source), F.lit("")), "__salt": salt,
    })
    plain = rows.select("__none", "__source", "size", "__salt")
    key = ["__none", "__source"]
    cells = plain.groupBy(*key, "size", "__salt").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy(*key, "size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy(*key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # all from the counts of cells, whose shuffle is reused: texts are read for them once
    by_size = cells.groupBy(*key, "size").agg(F.sum("n").alias("n"))
    targets = source_targets(by_size, weights, most)
    by_size = by_size.select(*key, "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("__below"))
    by_size = by_size.join(targets, key)
    cells = cells.select(*key, "size", "__salt", F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("__beside"))
    cells = cells.join(by_size, [*key, "size"])
    cell = [*key, "size", "__salt"]
    rows = rows.drop("source_size", "target", "copies", "taken", "rate").join(cells, cell)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*cell).orderBy(doc_id, "__tie")) + F.col("__below") + F.col("__beside"))
    u = offset(F.col("__source"), F.col("__none"), seed)
    crossed = F.floor(F.col("__rank") * F.col("rate") + u) - F.floor((F.col("__rank") - 1) * F.col("rate") + u)
    rows = rows.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("__none", "__source", "__salt", "__below", "__beside", "__rank", "__tie", "rate")


def emit(mixed: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
s2 AS (SELECT *, ((place - 1) % 3 + 1) AS w, 3.0::DOUBLE * ss / ((place - 1) % 3 + 1) AS cap FROM s1),
s3 AS (SELECT *, ((SELECT sum(ss) FROM s2) - coalesce(sum(3 * ss) OVER b, 0))::DOUBLE / ((SELECT sum(w) FROM s2) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev
  FROM s2 WINDOW b AS (ORDER BY cap, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lev, place0) AS lam FROM (SELECT lev, row_number() OVER (ORDER BY cap, place) AS place0 FROM s3 WHERE lev <= cap)),
t AS (SELECT source, ss, least(3.0::DOUBLE * ss, lam * w) AS target,
  ('0x' || substr(md5('mix-1' || CASE WHEN source IS NULL THEN '-' ELSE '+' END || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s3, l),
r AS (SELECT d.doc_id, d.size, t.ss, t.target, t.u, CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 2), d.doc_id NULLS FIRST) AS rk
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss AS source_size, target,
  (least(floor(rk * rate + u) - floor((rk - 1) * rate + u), 3) * size)::BIGINT AS taken FROM r
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # words are counted once: counts and documents both read the sizes
    sizes = stored(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")), "sizes")
    return mix(sizes, counted=True).select("doc_id", "size", "source_size", "target", "taken")
