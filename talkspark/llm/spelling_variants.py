"""Operator 12, grouping of spelling variants with a dictionary of trie-node pairs.

Words are numbered in code-point order, then the nodes of their trie and of the trie of the reversed words. A word cut at a
place is a pair (prefix node, suffix node). With the code point after the cut skipped, the pairs of two words are equal
where they differ by a replaced code point there; the pair of one word with a skip equals a pair of another without one
where a code point is inserted. So neighbours meet by equality of two integers, exactly. Rows with one pair are one word
without a skip at most, and words with a skip that differ in a single place, as many as there are letters (90) at most: a
bounded group, of which members need its size and its two most frequent words, not its pairs. A doubled letter may be
skipped at two places; only the first counts for insertions, so that no neighbour counts twice.

Nodes up to depth DIRECT are numbered by their code points themselves, so that no short prefix is a hot key; up to DEEP by a
table of the distinct prefixes and suffixes. Pairs deeper than DEEP in sum (very long words) are numbered by two rolling hashes of 61
bits, in a stream, as a table would grow with the square of a word's length.

Forms are followed to roots by doubling: counts grow fivefold by a step, so JUMPS doublings reach the end of any chain.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string in the digest; repeated rows
count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import cut

LEAST_LENGTH, LEAST_COUNT, TIMES, ONE_IN = 6, 5, 5, 199
DIRECT, DEEP, JUMPS = 3, 64, 5
LETTERS = r"a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIME, BASE = (1 << 61) - 1, 1_000_003


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, every ONE_INth by its digest with a code point left out, that are long and frequent enough."""
    low = F.translate(F.col(text), UPPER, LOWER)
    # shorter runs can't become longer; possessive, so that a run is taken whole
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % ONE_IN == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def numbered(words: DataFrame) -> DataFrame:
    """words with id, in code-point order, kept in the shared folder so that the numbers stay."""
    return cut(words.orderBy("word").withColumn("id", F.monotonically_increasing_id()))


def direct(letters: Column, depth: int) -> Column:
    """Number of the node of the first `depth` of an array of code points; below zero, unlike those of the table."""
    number = F.lit(0).cast("long")
    for d in range(depth):
        number = number * 65536 + F.get(letters, F.lit(d)).cast("long")
    return -1 - number


def trie_nodes(words: DataFrame) -> DataFrame:
    """words (id, n, word) of at most DEEP + 1 code points with fwd and rev: the nodes of their prefixes and suffixes by length."""
    short = words.where(F.length("word") <= DEEP + 1)
    n = F.length("word")
    depth = F.explode(F.sequence(F.lit(DIRECT + 1), F.least(n, F.lit(DEEP))))
    cuts = short.select("id", "word", n.alias("n_letters"), depth.alias("depth"))
    fore = cuts.select("id", "depth", F.lit(False).alias("back"), F.substring(F.col("word"), F.lit(1), F.col("depth")).alias("part"))
    aft = cuts.select("id", "depth", F.lit(True).alias("back"), F.substring(F.col("word"), F.col("n_letters") - F.col("depth") + 1, F.col("depth")).alias("part"))
    cuts = fore.unionByName(aft)
    nodes = cut(cuts.select("back", "part").distinct().withColumn("node", F.monotonically_increasing_id()))
    paths = cuts.join(nodes, ["back", "part"]).groupBy("id").agg(
        *(F.transform(F.array_sort(F.collect_list(F.when(F.col("back") == back, F.struct("depth", "node")))), lambda x: x["node"]).alias(name) for name, back in (("fore", False), ("aft", True)))
    )
    letters = F.transform(F.split("word", ""), F.ascii)
    out = short.join(paths, "id").withColumn("letters", letters)
    top = lambda a: F.array(*(direct(a, d) for d in range(DIRECT + 1)))
    return out.select("id", "n", "letters", F.concat(top(F.col("letters")), "fore").alias("fwd"), F.concat(top(F.reverse("letters")), "aft").alias("rev"))


def short_pairs(words: DataFrame) -> DataFrame:
    """(fore, aft, id, n, skips, first): the pairs of words up to DEEP in sum; first: the skip counts for insertions too."""
    nodes, size = trie_nodes(words), F.size("letters")
    node = lambda way, d: F.get(way, d.cast("int"))
    fresh = lambda p: F.coalesce(F.get(F.col("letters"), p) != F.get(F.col("letters"), p - 1), F.lit(True))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda p: F.struct(node("fwd", p).alias("fore"), node("rev", size - 1 - p).alias("aft"), F.lit(True).alias("skips"), fresh(p).alias("first")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda p: F.struct(node("fwd", p).alias("fore"), node("rev", size - p).alias("aft"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    both = F.when(size <= DEEP, F.concat(skips, whole)).otherwise(skips)
    return nodes.select("id", "n", F.explode(both).alias("p")).select("p.fore", "p.aft", "id", "n", "p.skips", "p.first")


def long_pairs(words: DataFrame) -> DataFrame:
    """The pairs of words that are deeper than DEEP in sum, with hashes for nodes; a stream, whatever a word's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        names, kinds = ["fore", "aft", "id", "n", "skips", "first"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for b in batches:
            for id_, n, word in zip(*(b.column(c).to_pylist() for c in ("id", "n", "word")), strict=True):
                fwd, rev = [0], [0]
                for c in word:
                    fwd.append((fwd[-1] * BASE + ord(c)) % PRIME)
                for c in reversed(word):
                    rev.append((rev[-1] * BASE + ord(c)) % PRIME)
                size, out = len(word), []
                for p in range(size + 1):
                    out.append((fwd[p], rev[size - p], id_, n, False, False))
                    if p < size and size - 1 > DEEP:
                        out.append((fwd[p], rev[size - 1 - p], id_, n, True, p == 0 or word[p] != word[p - 1]))
                    if len(out) >= 10_000:
                        yield made(out)
                        out = []
                if out:
                    yield made(out)

    return words.where(F.length("word") > DEEP).select("id", "n", "word").mapInArrow(run, "fore bigint, aft bigint, id bigint, n bigint, skips boolean, first boolean")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near each, and (n, -id) of the most frequent; words that have none stay out."""
    pairs = short_pairs(words).withColumn("deep", F.lit(False)).unionByName(long_pairs(words).withColumn("deep", F.lit(True)))
    rank = F.struct("n", (-F.col("id")).alias("less"))
    groups = pairs.groupBy("deep", "fore", "aft").agg(
        F.collect_list(F.when(F.col("skips"), F.struct("n", (-F.col("id")).alias("less"), "first"))).alias("skips"), F.max(F.when(~F.col("skips"), rank)).alias("whole"),
    ).where(F.size("skips") + F.col("whole").isNotNull().cast("int") > 1)
    # most frequent first: the last of an ascending sort by (n, -id)
    groups = groups.withColumn("skips", F.reverse(F.array_sort("skips"))).withColumn("firsts", F.filter("skips", lambda s: s["first"]))
    pick = lambda s: F.when(s.isNotNull(), F.struct(s["n"].alias("n"), s["less"].alias("less")))
    top = lambda k: pick(F.get(F.col("skips"), F.lit(k)))
    whole = F.col("whole")
    of_skip = F.transform("skips", lambda s, i: F.struct(
        (-s["less"]).alias("id"), (F.size("skips") - 1 + (s["first"] & whole.isNotNull()).cast("int")).cast("long").alias("n_near"),
        F.greatest(F.when(i == 0, top(1)).otherwise(top(0)), F.when(s["first"], whole)).alias("best"),
    ))
    of_whole = F.when(whole.isNotNull(), F.array(F.struct((-whole["less"]).alias("id"), F.size("firsts").cast("long").alias("n_near"), pick(F.get("firsts", F.lit(0))).alias("best")))).otherwise(F.array())
    met = groups.select(F.explode(F.concat(of_skip, of_whole)).alias("m")).select("m.*").where("n_near > 0")
    return met.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = numbered(word_counts(docs, doc_id, text))
    near = words.join(near_words(words), "id", "left")
    fits = F.col("best.n") >= TIMES * F.col("n")
    near = cut(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_id"), F.when(fits, F.col("best.n")).alias("form_n")))
    ways = near.where("form_id is not null").select("id", F.col("form_id").alias("to"))
    for _ in range(JUMPS):
        ways = cut(ways.join(ways.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.coalesce("then", "to").alias("to")))
    name = lambda key, as_: near.select(F.col("id").alias(key), F.col("word").alias(as_))
    ends = ways.join(name("to", "root"), "to").select("id", "root")
    out = near.join(name("form_id", "form"), "form_id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 by half bytes: the table of 16 entries is made by rule.
ORACLE = f"""
WITH RECURSIVE tb AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(16)) AS k))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS k FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
x AS (SELECT run, k, hex(encode(id || ':' || run)) AS hx FROM g),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hx)), lambda i: ('0x' || substr(hx, (i + 2 - 2 * (i % 2))::INT, 1))::BIGINT)),
 lambda c, b: xor(t[(xor(c, b) & 15) + 1], c >> 4))) AS h FROM x, tb),
w AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
wc AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
sk AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS s FROM (SELECT word, n, unnest(range(length(word)))::INT AS p FROM wc)),
nr AS (SELECT a.word, b.word AS o, b.n AS o_n FROM sk a JOIN sk b ON a.s = b.s AND a.p = b.p AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM sk a JOIN wc b ON a.s = b.word UNION SELECT b.word, a.word, a.n FROM sk a JOIN wc b ON a.s = b.word),
nn AS (SELECT word, count(*) AS n_near, first(struct_pack(o := o, o_n := o_n) ORDER BY o_n DESC, o) AS b FROM nr GROUP BY word),
f AS (SELECT wc.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b.o_n >= {TIMES} * n THEN b.o END AS form, CASE WHEN b.o_n >= {TIMES} * n THEN b.o_n END AS form_n FROM wc LEFT JOIN nn USING (word)),
c AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, d) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""
