"""Operator 11, license scans by diagonal voting.

Words are the runs of [0-9a-z] and of all characters beyond ASCII, A-Z lower-cased. Hashes of all rolling GRAM-word grams of
every text are joined to the positions of the same grams in license templates. A hit at word i of a text and
gram j of a template votes for the diagonal i - j: text that follows a template votes for one diagonal, and words put in or
left out move it by their number. Votes are bit masks of template positions, so that repeats count once and a group is a few
numbers whatever the text. Diagonals of a template that are DRIFT apart at most are merged to a span. A span is verified
if it covers LEAST_SHARE of the template's grams and is at most REACH times as long as the template. Its label joins those of
the phrases that stand in the text word for word; score is 1 with such a phrase, else the largest verified share, else 0.

Only DataFrame and SQL functions are used. Grams are compared by 64-bit hashes; one false gram alone covers too little of any
template of five grams or more to be verified.

Defined results: a null or empty text has no words, empty labels and score 0; rows with equal doc_id and text are scanned as one
and given back as often as they came; templates of under GRAM words are never found; other columns stay out of the result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkspark.llm.common import cut, with_groups

GRAM, DRIFT, LEAST_SHARE, REACH = 3, 4, 0.6, 1.5
#: Template positions in one bit mask.
BITS = 62
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def grams(words: Column) -> Column:
    """Hash of each gram of a materialised array of words."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(GRAM))))
    return F.when(n >= GRAM, each).otherwise(F.array().cast("array<bigint>"))


def template_positions(templates: DataFrame) -> DataFrame:
    """(gram, at): the places of each gram in templates (label, text): template number, gram number, grams, words, label."""
    t = templates.select("label", "text", license_words(F.col("text")).alias("words")).distinct()
    t = t.withColumn("template", F.xxhash64("label", "text")).select("label", "template", "words", F.posexplode(grams(F.col("words"))).alias("j", "gram"))
    place = F.struct("template", F.col("j").cast("long").alias("j"), (F.size("words") - GRAM + 1).cast("long").alias("n_grams"), F.size("words").cast("long").alias("n_template"), "label")
    return t.groupBy("gram").agg(F.array_sort(F.collect_list(place)).alias("at"))


def places_of(words: Column, text: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively; only texts that hold its longest word are searched."""
    parts = phrase.split(" ")
    here = lambda i: reduce(and_, (F.get(words, i + j).eqNullSafe(p) for j, p in enumerate(parts)))
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when((F.size(words) > 0) & text.contains(max(parts, key=len)), found).otherwise(F.array().cast("array<int>"))


def scanned(docs: DataFrame, templates: DataFrame, phrases: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(doc_id).alias("doc_id"), low.alias("low"))
    rows = rows.select("doc_id", F.xxhash64("low").alias("k1"), F.crc32(F.col("low").cast("binary")).alias("k2"), "low", F.array_remove(F.split("low", SEPARATOR), "").alias("words"))
    for n, p in enumerate(phrases):
        rows = rows.withColumn(f"p{n}", places_of(F.col("words"), F.col("low"), p))
    every = F.concat(*(F.col(f"p{n}") for n in range(len(phrases)))) if phrases else F.array().cast("array<int>")
    labels = F.concat(*(F.when(F.size(f"p{n}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for n, label in enumerate(phrases.values()))) if phrases else F.array().cast("array<string>")
    own = F.struct(F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    # a last gram, 0 at place -1, stands for the row itself, so that texts without a hit stay
    hashes = F.concat(F.transform(grams(F.col("words")), lambda g: F.when(g == 0, F.lit(1)).otherwise(g)), F.array(F.lit(0).cast("bigint")))
    rows = rows.select("doc_id", "k1", "k2", own.alias("own"), hashes.alias("hashes"))
    # outer: an inner one infers a filter on the hashes, which would be pushed below the words and split the text for every gram
    rows = rows.select("doc_id", "k1", "k2", "own", F.posexplode_outer("hashes").alias("i", "gram"))
    itself = F.array(F.struct(F.lit(0).cast("bigint").alias("template"), F.lit(0).cast("bigint").alias("j"), F.lit(1).cast("bigint").alias("n_grams"), F.lit(0).cast("bigint").alias("n_template"), F.lit(None).cast("string").alias("label")))
    positions = template_positions(templates)
    one = positions.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("gram"), itself.alias("at"))
    hits = with_groups(rows, cut(positions.where("gram <> 0").unionByName(one)), "gram")
    hits = hits.select("doc_id", "k1", "k2", F.when(F.col("gram") == 0, F.col("own")).alias("own"), "i", F.explode("at").alias("at")).select("doc_id", "k1", "k2", "own", "i", "at.*")
    key, itself = ["doc_id", "k1", "k2"], F.col("own").isNotNull()
    votes = hits.groupBy(*key, "own", "template", "label", "n_grams", "n_template", F.when(itself, 0).otherwise(F.col("i") - F.col("j")).alias("diagonal"), F.floor(F.col("j") / BITS).alias("part")).agg(
        F.bit_or(F.when(itself, 0).otherwise(F.expr(f"shiftleft(1L, cast(j % {BITS} as int))"))).alias("mask"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_if(itself).alias("copies"),
    )
    along = Window.partitionBy(*key, "template").orderBy("diagonal", "part")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(False)).cast("int")
    spans = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    at = [*key, "own", "template", "span", "label", "n_grams", "n_template"]
    parts = spans.groupBy(*at, "part").agg(F.bit_count(F.bit_or("mask")).alias("covered"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("copies").alias("copies"))
    spans = parts.groupBy(*at).agg(F.sum("covered").alias("covered"), (F.max("hi") + GRAM - F.min("lo")).alias("length"), F.max("copies").alias("copies"))
    fine = F.col("own").isNull() & (F.col("covered") >= LEAST_SHARE * F.col("n_grams")) & (F.col("length") <= REACH * F.col("n_template"))
    found = spans.groupBy(*key).agg(F.max("own").alias("own"), F.max("copies").alias("copies"), F.collect_set(F.when(fine, F.col("label"))).alias("found"), F.max(F.when(fine, F.col("covered") / F.col("n_grams"))).alias("share"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "own.n_words", "own.n_base", "own.first_word", "own.last_word", joined(F.col("own.base")).alias("base_labels"), joined(F.concat("own.base", "found")).alias("labels"),
        F.when(F.col("own.n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    ).drop("copy")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scanned(docs, spark.createDataFrame(TEMPLATES, "label string, text string"), PHRASES)


def oracle() -> str:
    values = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    low = f"regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}')"
    words = f"list_filter({low}, lambda x: x <> '')"
    cases = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS i, '{label}' AS label FROM pos WHERE " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p.split(" "))) for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
base AS ({cases}),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM base GROUP BY rid),
tt AS (SELECT row_number() OVER () AS t, label, {words} AS ws FROM (VALUES {values}) v(label, text)),
tg AS (SELECT t, label, len(ws) AS nt, len(ws) - {GRAM - 1} AS ng, unnest(range(len(ws) - {GRAM - 1})) AS j, ws FROM tt WHERE len(ws) >= {GRAM}),
tp AS (SELECT t, label, nt, ng, j, array_to_string(ws[j + 1:j + {GRAM}], ' ') AS g FROM tg),
dg AS (SELECT rid, i - 1 AS i, array_to_string(ws[i:i + {GRAM - 1}], ' ') AS g FROM pos WHERE i + {GRAM - 1} <= len(ws)),
hit AS (SELECT DISTINCT rid, t, label, nt, ng, i, j, i - j AS dg FROM dg JOIN tp USING (g)),
ap AS (SELECT *, CASE WHEN dg - lag(dg) OVER (PARTITION BY rid, t ORDER BY dg, j) > {DRIFT} THEN 1 ELSE 0 END AS a FROM hit),
sp AS (SELECT *, sum(a) OVER (PARTITION BY rid, t ORDER BY dg, j ROWS UNBOUNDED PRECEDING) AS s FROM ap),
v AS (SELECT rid, label, count(DISTINCT j) / ng AS share FROM sp GROUP BY rid, t, label, nt, ng, s HAVING count(DISTINCT j) >= {LEAST_SHARE} * ng AND max(i) + {GRAM} - min(i) <= {REACH} * nt),
f AS (SELECT rid, list(DISTINCT label) AS ls, max(share) AS share FROM v GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)"""


ORACLE = oracle()
