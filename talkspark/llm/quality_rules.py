"""Operator 1, quality rules with adaptive thresholds.

Counts of every whole text give three shares: symbols per word, repeated lines per line, repeated words per
word. For each (lang, source) a KLL quantile sketch of each share is built; merged sketches give the language
and the whole corpus. The threshold of a share is q + reach * (q - median), with the share's quantile and reach in
RULES, of the finest level that holds at least LEAST documents (that pass the base rule). No cutoff is fixed: a
group of listings with many symbols gets a high threshold, a group of prose a low one. q is low for symbols, as junk may
be a tenth of a group, and high for repeats, of which clean texts have some. Where all of that is zero, EPSILON lets a
single symbol or repeat in a long text pass. Sketches and thresholds are joined back to the documents; a document is
kept when it passes the base rule and all its thresholds.

Only DataFrame and SQL functions are used. Within a text, five-word windows are compared by 64-bit hashes
(within one text of a million words the chance of a false repeat is about 3e-8).

Defined results: a null or empty text has zero in all counts and fails the base rule (under 10 words); null
lang and null source are groups of their own; repeated rows are judged one by one; an empty table gives no
rows; other columns pass through, and an input column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import WHITE, cut, stored, with_groups, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Documents that a group needs for thresholds of its own; size of the sketches.
LEAST, SKETCH_K = 100, 2048
#: Of each share, the quantile that its threshold is built on, and the reach beyond it.
RULES = {"symbol_share": (0.8, 3.0), "line_share": (0.99, 1.0), "repeat_share": (0.99, 1.0)}
#: What a threshold is where quantile and median are zero.
EPSILON = 0.01


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = docs.withColumn("__words", words_of(F.col(text)))
    w = w.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "__lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""),
        "__hashes": F.transform("__words", lambda x: F.xxhash64(x)),
    }).drop("__words")
    w = w.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
                lambda i: F.xxhash64(*(F.get(F.col("__hashes"), i + F.lit(j)) for j in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    }).drop("__lines", "__hashes")
    w = w.withColumn("n_repeat_words", repeat_words(F.col("__windows")))
    return w.drop("__windows")


def repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Only texts with a repeat pay for sorting (hash, place) pairs: equal neighbours mark places, and each place
    adds the words up to the one before it, five at most. Lambdas bind sorted arrays, so each is made once.
    """
    def gaps(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(p - F.get(places, j - F.lit(1)), F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b,
        )

    def covered(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, j: F.coalesce(F.get(pairs, j - F.lit(1))["k"] == x["k"], F.lit(False))
            | F.coalesce(F.get(pairs, j + F.lit(1))["k"] == x["k"], F.lit(False)),
        )
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        return F.transform(F.array(places), gaps)[0]

    pairs = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, F.transform(F.array(pairs), covered)[0]).otherwise(0).cast("long")


def judged(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counts with base_failed, the three shares, their thresholds and kept. counts is read twice."""
    shares = {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
        "line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = counts.withColumns({"base_failed": failed, **shares, "__lang": F.col(lang), "__source": F.col(source)})
    fine = rows.where(~F.col("base_failed")).groupBy("__lang", "__source").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in shares)
    )

    def merged(by: list[str]) -> DataFrame:
        return fine.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in shares))

    def limits(sketches: DataFrame, level: str, by: list[str]) -> DataFrame:
        q = lambda s, r: F.kll_sketch_get_quantile_double(s, F.lit(r))
        made = [F.greatest(F.lit(EPSILON), q(s, r) + reach * (q(s, r) - q(s, 0.5))).alias(s) for s, (r, reach) in RULES.items()]
        return sketches.select(*by, F.struct("n", *made).alias(level))

    cells = limits(fine, "fine", ["__lang", "__source"])
    langs = limits(merged(["__lang"]), "lang_level", ["__lang"])
    whole = limits(merged([]), "whole", [])
    # one row for each (lang, source), a few numbers wide
    found = cells.alias("c").join(langs.alias("g"), F.col("c.__lang").eqNullSafe(F.col("g.__lang"))).select(
        F.to_json(F.struct(F.col("c.__lang").alias("a"), F.col("c.__source").alias("b"))).alias("__group"),
        F.when(F.col("fine.n") >= LEAST, F.col("fine")).when(F.col("lang_level.n") >= LEAST, F.col("lang_level")).alias("__own"),
    )
    rows = rows.withColumn("__group", F.to_json(F.struct(F.col("__lang").alias("a"), F.col("__source").alias("b")))).drop("__lang", "__source")
    every = rows.select("__group").distinct().join(found, "__group", "left")
    rows = with_groups(rows, cut(every), "__group")
    rows = rows.join(F.broadcast(whole.limit(1)))  # one row: an aggregate without keys
    limit = F.coalesce("__own", "whole")
    rows = rows.withColumns({f"{s}_limit": limit[s] for s in shares}).drop("__own", "whole", "__group")
    passed = F.lit(True)
    for s in shares:
        passed = passed & (F.col(s) <= F.coalesce(F.col(f"{s}_limit"), F.lit(float("inf"))))
    return rows.withColumn("kept", ~F.col("base_failed") & passed)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with counts, shares, thresholds, base_failed and kept."""
    # stored first: a filter on the counts, pushed below them, would make each window from the whole text again
    return judged(stored(text_counts(docs, text), "counts"), lang, source)


ORACLE = """
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(5, coalesce(i - p, 5)))::BIGINT AS r FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM dup) GROUP BY rid),
ln AS (SELECT rid, count(*) AS nl, count(*) - count(DISTINCT l) AS nd FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w)
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(nl, 0)::BIGINT AS nl, coalesce(nd, 0)::BIGINT AS n_dup_lines,
    coalesce(r, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS a,
    n_dup_lines / greatest(nl, 1) AS b, n_repeat_words / greatest(n_words, 1) AS d FROM c),
lv AS (SELECT lang, source, grouping_id(lang, source) AS g, count(*) AS n,
    greatest(0.01, quantile_disc(a, 0.8) + 3.0 * (quantile_disc(a, 0.8) - quantile_disc(a, 0.5))) AS la,
    greatest(0.01, quantile_disc(b, 0.99) + (quantile_disc(b, 0.99) - quantile_disc(b, 0.5))) AS lb,
    greatest(0.01, quantile_disc(d, 0.99) + (quantile_disc(d, 0.99) - quantile_disc(d, 0.5))) AS ld
    FROM s WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
j AS (SELECT s.*, CASE WHEN x.n >= 100 THEN x.la WHEN x.n IS NOT NULL AND y.n >= 100 THEN y.la ELSE z.la END AS la,
    CASE WHEN x.n >= 100 THEN x.lb WHEN x.n IS NOT NULL AND y.n >= 100 THEN y.lb ELSE z.lb END AS lb,
    CASE WHEN x.n >= 100 THEN x.ld WHEN x.n IS NOT NULL AND y.n >= 100 THEN y.ld ELSE z.ld END AS ld
    FROM s LEFT JOIN (SELECT * FROM lv WHERE g = 0) x ON s.lang IS NOT DISTINCT FROM x.lang AND s.source IS NOT DISTINCT FROM x.source
    LEFT JOIN (SELECT * FROM lv WHERE g = 1) y ON s.lang IS NOT DISTINCT FROM y.lang LEFT JOIN (SELECT * FROM lv WHERE g = 3) z ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND a <= coalesce(la, 'inf'::DOUBLE) AND b <= coalesce(lb, 'inf'::DOUBLE) AND d <= coalesce(ld, 'inf'::DOUBLE) AS kept FROM j
"""


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    # the counts, a few numbers for each text, are kept: sketches and verdicts both read them
    out = judged(cut(text_counts(docs).drop("text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
