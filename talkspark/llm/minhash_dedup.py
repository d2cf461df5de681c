"""Operator 3, near-duplicate documents by MinHash signatures in a signature-coordinate inverted join.

A text is its set of distinct SHINGLE-word shingles (A-Z lower-cased; fewer words: the whole sequence as one).
Texts with equal sets are one node. A node's signature has COORDINATES min-wise values; a node is posted under each
coordinate-value pair. Two sets at the similarity limit of 0.8 agree in under MATCHES = 35 of 64 coordinates with
probability 1.2e-6 (binomial), so a link needs MATCHES collisions, and confirmation on full sets.

Prefix merging: coordinates that no other node has can't collide, so a node with under MATCHES shared ones is done.
Of c shared ones only the c - MATCHES + 1 rarest are kept as lists: two nodes with MATCHES collisions share one there.
Lists are not expanded into pairs. Each has a representative, its most central node (the one whose coordinates are
the most common in it); every node meets the representatives of its lists, collisions are counted on whole
signatures, and pairs of NEAR or more are compared on full sets: links, and how a node differs from its
representative. Components of the links are found. In lists of REPS + 1 nodes at most that have several, the REPS most central
ones are met by nodes of other components, so all such pairs of these lists have met.

Skip merging: what is left are pairs of different components in one list. If two sets of a representative's list
differ from it in no shingle alike (neither one that both have and it has not, nor one that it has and both have
not), each is as similar to it as to the other at least. So a pair that isn't linked through the representative must share
differences: need(A, X) = 4/9 (|A| + |X|) - |A & R| - |X & R| + |R| of them. Nodes of a representative's group are posted
under differences only; the long lists of what the group has in common are skipped. Differences that one node only
has count for no pair; a node that has too few others leaves; the rest is posted under its rarest
differences, a prefix as long as its least need demands, and pairs that meet are tested against need(A, X), the
collisions of their signatures and their full sets. Nodes that are in a list but unlike its representative (two sets
at under 0.6 and over 0.8 of it can't be linked) are posted under the rarest of their shingles instead, with the same bounds
against the empty set. A large group of near copies so costs links to representatives, not pairs.

Shingles are compared by 64-bit hashes, sets by 128-bit ones; a node's number is given when nodes are written. Its place is a
hash of its row's key, which a row has before any join: texts are shuffled once, into buckets of places.

Defined results: a null text or one without words has an empty set and is linked with nothing; rows with a null
doc_id are linked like others but never name a component (component_id null when nothing else does); repeated
rows and equal sets are one component; an empty table gives no rows; other columns take no part. `kept` is doc_id = component_id, true where component_id is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.llm.bpe import slices, with_column
from talkspark.llm.common import cut, shared_dir, shuffled, stored, tidy

SHINGLE, LIMIT = 2, (80, 100)
#: Coordinates of a signature; collisions that a link needs; those of pairs that are compared with their representative.
COORDINATES, MATCHES, NEAR = 64, 35, 19
#: Representatives of a short list, of up to one node more, that all its nodes of other components meet.
REPS = 6
#: Similarity to a representative from which on a node is in its group: 1 - 2 * (1 - limit).
GROUP = 2 * LIMIT[0] - LIMIT[1]
#: Passes that leave out what one node only has and nodes with too little else.
SKIPS = 2
SLICE = 4_000_000

_random = np.random.default_rng(20)
BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, *range(9, 14)]] = True
BYTE_CODE[IS_WHITE] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MULTIPLY = _random.integers(0, 2**31, (COORDINATES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _random.integers(0, 2**32, (COORDINATES, 1), dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Shingle sets of texts; powers of the hash base are kept for the longest slice so far."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.up, self.down = shingle, powers(BASE, 1), powers(BASE_INVERSE, 1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        data = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        if len(self.up) < len(data):
            self.up, self.down = powers(BASE, len(data)), powers(BASE_INVERSE, len(data))
        white = IS_WHITE[data]
        inside = ~white
        first = np.flatnonzero(inside & np.concatenate([[True], white[:-1]]))
        if not len(first):
            return [np.zeros(0, np.uint64)] * len(texts)
        codes = BYTE_CODE[data]
        codes *= self.up[: len(data)]
        words = mixed(np.add.reduceat(codes, first) * self.down[first])
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        edges = np.searchsorted(first, begins)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            w, k = words[a:b], min(self.shingle, b - a)
            s = np.zeros(max(0, b - a - k + 1) if k else 0, np.uint64)
            for j in range(k):
                s = s * BASE + w[j : j + len(s)]
            out.append(np.unique(mixed(s + np.uint64(k))))
        return out


def coordinates(s: np.ndarray) -> np.ndarray:
    """The signature of a set: the least value of each coordinate."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTIPLY), 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        part = low[None, i : i + 1024] * MULTIPLY
        part += ADD
        np.minimum(least, part.min(axis=1), out=least)
    return least.view(np.int32)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text: n_shingles, digest (of the set; null if empty), coords (signature)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start, n in slices(batch.column(text), SLICE):
                part = batch.slice(start, n)
                sets = shingler.sets([(t or "").encode() for t in part.column(text).to_pylist()])
                nodes = [
                    np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ BASE).sum(dtype=np.uint64)]).tobytes() if len(s) else None for s in sets
                ]
                made = [coordinates(s) if len(s) else None for s in sets]
                part = part.select([c for c in part.schema.names if c != text])
                part = with_column(part, "n_shingles", pa.array([len(s) for s in sets], pa.int64()))
                part = with_column(part, "digest", pa.array(nodes, pa.binary()))
                yield with_column(part, "coords", pa.array(made, pa.list_(pa.int32())))

    fields = [f for f in docs.schema.fields if f.name not in (text, "n_shingles", "digest", "coords")]
    made = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("coords", T.ArrayType(T.IntegerType()))]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, *made]))


def compared(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, text_a, text_b): a, b, n_a, n_b, both (shingles in common), more and less (what a has more and less than b)."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for start, n in slices(batch.column("text_a"), SLICE // 4):
                part = batch.slice(start, n)
                sets = shingler.sets([t.encode() for t in part.column("text_a").to_pylist()])
                sizes, both, more, less = [], [], [], []
                for k in range(n):
                    b = part.column("b")[k].as_py()
                    if b != last[0]:  # rows of one representative follow each other mostly
                        last = b, shingler.sets([part.column("text_b")[k].as_py().encode()])[0]
                    s, t = sets[k], last[1]
                    shared = np.isin(s, t, assume_unique=True)
                    sizes.append((len(s), len(t)))
                    both.append(int(shared.sum()))
                    near = LIMIT[1] * both[-1] >= GROUP * (len(s) + len(t) - both[-1])
                    more.append(s[~shared].view(np.int64) if near else None)
                    less.append(np.setdiff1d(t, s, assume_unique=True).view(np.int64) if near else None)
                made = [pa.array([x for x, _ in sizes], pa.int64()), pa.array([x for _, x in sizes], pa.int64()), pa.array(both, pa.int64()), pa.array(more, longs), pa.array(less, longs)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *made], ["a", "b", "n_a", "n_b", "both", "more", "less"])

    schema = "a bigint, b bigint, n_a bigint, n_b bigint, both bigint, more array<bigint>, less array<bigint>"
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), schema)


def linked() -> Column:
    """Whether sets of n_a and n_b shingles, `both` in common, are similar enough."""
    return LIMIT[1] * F.col("both") >= LIMIT[0] * (F.col("n_a") + F.col("n_b") - F.col("both"))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) of all nodes of the links (a, b): comp is the least node of the component.

    Each turn every node takes the least label among itself and its neighbours, then the label of its label;
    every turn is checkpointed, and only whether anything changed comes to the driver. known: labels so far,
    whose (node, comp) count as links.
    """
    if known is not None:
        edges = edges.unionByName(known.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
    links = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = links.join(shuffled(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node", "left").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = cut(step.join(jump, "next", "left").select("node", "comp", F.least("next", "far").alias("next")))
        labels = step.select("node", F.col("next").alias("comp"))
        if step.where("comp <> next").isEmpty():
            return labels


def prefixes(nodes: DataFrame) -> DataFrame:
    """(key, node, central, size) of the lists that prefix merging keeps. nodes: (node, coords)."""
    key = F.transform("coords", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(2**32 - 1))))
    posted = nodes.select("node", F.explode(key).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = posted.join(shuffled(lists), "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("posts"))
    shared = shared.where(F.size("posts") >= MATCHES).withColumn("sizes", F.transform("posts", lambda x: x["members"]))
    kept = shared.select("node", "sizes", F.explode(F.expr(f"slice(posts, 1, size(posts) - {MATCHES - 1})")).alias("p"))
    # how common a node's coordinates are, those beyond the list's own size alike
    central = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + F.least(x, F.col("p.members")))
    kept = stored(kept.select(F.col("p.key").alias("key"), "node", central.alias("central")), "prefixes")
    several = kept.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(kept.join(shuffled(several), "key"), "lists")


def representatives(lists: DataFrame) -> DataFrame:
    """(key, rep): the most central node of each list."""
    best = F.max(F.struct("central", F.xxhash64("node").alias("tie"), "node")).alias("r")
    return lists.groupBy("key").agg(best).select("key", F.col("r.node").alias("rep"))


def unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with comp: those that hold more than one component. Lists of one component are skipped from here on."""
    at = lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return stored(at.join(several, "key"), "unsettled")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, shingle) of every shingle of texts (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start, n in slices(batch.column("text"), SLICE):
                part = batch.slice(start, n)
                sets = shingler.sets([t.encode() for t in part.column("text").to_pylist()])
                whose = pa.array(np.repeat(np.arange(n), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column("node").take(whose), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node bigint, shingle long")


def rarest(rows: DataFrame, by: list[str], feature: list[str]) -> DataFrame:
    """Rows (by, feature, comp, have, need, ...) that can still make a pair, each node's rarest ones only.

    Features of one node or one component only are left out, and nodes whose others are under their need. need: what a
    node must share with any partner, at least. Out comes `have`, the number of a node's features that others have too, and the place `at`.
    """
    for _ in range(SKIPS):
        several = rows.groupBy(*feature).agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select(*feature, "c")
        rows = rows.drop("c", "have").join(shuffled(several), feature)
        node = Window.partitionBy(*by)
        rows = stored(rows.withColumn("have", F.count("*").over(node)).where("have >= need"), "rarest")
    order = F.row_number().over(Window.partitionBy(*by).orderBy("c", *feature))
    return cut(rows.withColumn("at", order).where("at <= have - need + 1").drop("c"))


def by_differences(groups: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of different components in one representative's group that share enough differences from it.

    groups: (rep, node, comp, n, n_rep, both, more, less). In 180ths, a pair needs q_a + q_b + 20 n_rep differences,
    where q = 80 (n + n_rep) - 180 both is over 0 for nodes that aren't linked with the representative.
    """
    total, low = sum(LIMIT), LIMIT[0]
    q = low * (F.col("n") + F.col("n_rep")) - total * F.col("both")
    g = groups.withColumn("q", q).withColumn("stray", F.col("q") > 0)
    some = g.groupBy("rep").agg(F.min("q").alias("least"), F.min(F.when(F.col("stray"), F.col("q"))).alias("least_stray")).where("least_stray is not null")
    g = g.join(some, "rep")
    own = (total - 2 * low) * F.col("n_rep")
    # of two nodes one is a stray at least: both others meet strays only
    need = F.greatest(F.ceil((F.col("q") + own + F.when(F.col("stray"), F.col("least")).otherwise(F.col("least_stray"))) / total), F.lit(1))
    g = g.withColumn("need", need).where(F.size("more") + F.size("less") >= F.col("need"))
    tagged = F.concat(F.transform("more", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("shingle"))), F.transform("less", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("shingle"))))
    rows = g.select("rep", "node", "comp", "n", "q", "stray", "need", own.alias("own"), F.explode(tagged).alias("f"))
    rows = stored(rows.select("*", F.col("f.kind").alias("kind"), F.col("f.shingle").alias("shingle")).drop("f"), "differences")
    kept = rarest(rows, ["rep", "node"], ["rep", "kind", "shingle"])
    side = lambda x: kept.select("rep", "kind", "shingle", *([F.col("own")] if x == "a" else []), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "comp", "q", "stray", "have", "at")])
    # the first difference that a pair shares has all others behind it in both
    behind = F.least(F.col("have_a") - F.col("at_a"), F.col("have_b") - F.col("at_b")) + 1
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("stray_a") | F.col("stray_b"))
    fits &= total * behind >= F.col("q_a") + F.col("q_b") + F.col("own")
    pairs = side("a").join(shuffled(side("b")), ["rep", "kind", "shingle"]).where(fits)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct()


def by_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of different components that share enough shingles and are in no group together.

    nodes: (node, n, comp, reps), reps the representatives whose group a node is in; texts: theirs.
    """
    total, low = sum(LIMIT), LIMIT[0]
    # a partner has LIMIT of the node's size at least, and so must share 0.8 of it
    nodes = nodes.withColumn("need", F.ceil(F.col("n") * low / LIMIT[1]))
    rows = stored(shingle_rows(texts).join(shuffled(nodes.drop("reps")), "node"), "shingles")
    kept = rarest(rows, ["node"], ["shingle"]).join(shuffled(nodes.select("node", "reps")), "node")
    side = lambda x: kept.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "comp", "have", "at", "reps")])
    behind = F.least(F.col("have_a") - F.col("at_a"), F.col("have_b") - F.col("at_b")) + 1
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (total * behind >= low * (F.col("n_a") + F.col("n_b")))
    pairs = side("a").join(shuffled(side("b")), "shingle").where(fits & ~F.arrays_overlap("reps_a", "reps_b"))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (a hash of the text) of each row."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *same_text(doc_id, text))
    rows = stored(signatures(slim), "signatures")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("coords").alias("coords"), F.first("n_shingles").alias("n"), F.min(F.struct("id_key", "text_key")).alias("row")).select("digest", "id", "coords", "n", "row.*")
    nodes, salt = placed(stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes"))
    lists = prefixes(nodes.select("node", "coords"))
    listed = shuffled(lists.select("node").distinct())
    sig = nodes.select("node", "n", "coords", "place").join(listed, "node", "left_semi")
    # one text for each node; any of those with its set will do
    table = nodes_texts(docs, nodes.join(listed, "node", "left_semi"), salt, text, doc_id)
    texts = spark.table(table)

    def looked_at(pairs: DataFrame, matches: int, name: str) -> DataFrame:
        """Of pairs (a, b), b the representative if one is, those with enough collisions, compared on full sets."""
        pairs = pairs.select("a", "b").join(shuffled(sig.toDF("a", "n_a", "coords_a", "place_a")), "a").join(shuffled(sig.toDF("b", "n_b", "coords_b", "place_b")), "b")
        equal = F.aggregate(F.zip_with("coords_a", "coords_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
        least = GROUP if matches == NEAR else LIMIT[0]  # a set's size against the other's, for that similarity
        pairs = stored(pairs.where((equal >= matches) & (F.least("n_a", "n_b") * LIMIT[1] >= F.greatest("n_a", "n_b") * least)).select("a", "b", "place_a", "place_b"), "pairs")
        # representatives' texts only are shuffled, and those of the pairs' other side, which a large group splits over tasks
        others = texts.join(shuffled(pairs.select(F.col("place_b").alias("place")).distinct()), "place")
        pairs = pairs.join(shuffled(texts.toDF("place_a", "text_a")), "place_a").join(shuffled(others.toDF("place_b", "text_b")), "place_b")
        return stored(compared(pairs), name)

    try:
        reps = cut(representatives(lists))
        met = lists.join(shuffled(reps), "key").where(F.col("node") != F.col("rep"))
        first = looked_at(met.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), NEAR, "representatives")
        labels = components(first.where(linked()).select("a", "b"))

        left = unsettled(lists.where(F.col("size") <= REPS + 1), labels)
        central = Window.partitionBy("key").orderBy(F.desc("central"), F.xxhash64("node"), "node")
        few = left.withColumn("place", F.row_number().over(central)).where(F.col("place") <= REPS).select("key", F.col("node").alias("rep"), F.col("comp").alias("rep_comp"))
        met = left.join(shuffled(few), "key").where(F.col("comp") != F.col("rep_comp"))
        met = met.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
        second = looked_at(met, MATCHES, "seconds").where(linked()).select("a", "b")
        if not second.isEmpty():
            labels = components(second, labels)

        left = unsettled(lists.where(F.col("size") > REPS + 1), labels).join(shuffled(reps), "key").select("rep", "node", "comp").distinct()
        left = cut(left.join(nodes.select("node", "n"), "node"))
        groups = left.join(shuffled(first.select(F.col("a").alias("node"), F.col("b").alias("rep"), "n_a", "n_b", "both", "more", "less")), ["rep", "node"], "left")
        groups = stored(groups.withColumn("near", F.col("more").isNotNull()).withColumn("linked", F.coalesce(linked(), F.col("rep") == F.col("node"))), "groups")
        apart = groups.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_set(F.when(F.col("near") | F.col("linked"), F.col("rep"))).alias("reps"), F.max(~F.col("linked")).alias("apart"))
        apart = apart.where("apart").drop("apart")
        whose = apart.select("node").join(shuffled(nodes.select("node", "place")), "node")
        pairs = by_shingles(apart, texts.join(shuffled(whose), "place").select("node", "text")).unionByName(by_differences(groups.where("near").withColumnRenamed("n_b", "n_rep").drop("near", "linked", "n_a")))
        sizes = F.least("n_a", "n_b") * LIMIT[1] >= F.greatest("n_a", "n_b") * LIMIT[0]
        third = looked_at(pairs.where(sizes).select("a", "b").distinct(), MATCHES, "rest").where(linked()).select("a", "b")
        if not third.isEmpty():
            labels = components(third, labels)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")

    named = nodes.select("node", "id", "digest").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.select("digest", "comp").join(least, "comp").select("digest", "component_id")
    out = rows.select("id", "n_shingles", "digest", "text_key").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), "text_key")
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.col("component_id").isNull()))


def same_text(doc_id: str, text: str) -> list[Column]:
    """A row's own key: its id and a hash of its text, as ids may be null or repeated."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("-")).alias("id_key"), F.xxhash64(text).alias("text_key")]


def place_of(salt: int) -> Column:
    """A row's place, from its own key."""
    return F.xxhash64("id_key", "text_key", F.lit(salt))


def placed(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with their place, and the first salt with which no two nodes have the same one."""
    salt = 0
    while not nodes.groupBy(place_of(salt)).count().where("count > 1").isEmpty():
        salt += 1
    return nodes.withColumn("place", place_of(salt)), salt


def texts_of(docs: DataFrame, nodes: DataFrame, salt: int, buckets: int, text: str, doc_id: str) -> DataFrame:
    """(place, text) of one row of each node (place, id_key, text_key), in as many partitions by place as there are buckets."""
    found = docs.select(*same_text(doc_id, text), F.col(text).alias("text")).where("text is not null").withColumn("place", place_of(salt))
    # the join deals texts as the buckets do, so that they are shuffled once
    whose = nodes.select("place", F.struct("id_key", "text_key").alias("row")).repartition(buckets, "place")
    found = found.repartition(buckets, "place").join(whose.hint("merge"), "place")
    # repeated rows: one of them, in the partition that the join made; rows of another key are at this place by chance
    own = F.when(F.struct("id_key", "text_key") == F.col("row"), F.col("text"))
    return found.groupBy("place").agg(F.min(own).alias("text"))


def nodes_texts(docs: DataFrame, nodes: DataFrame, salt: int, text: str, doc_id: str) -> str:
    """The name of a table (place, text), bucketed by place, of the text of one row of each node: its joins by place move no text."""
    spark = docs.sparkSession
    buckets = min(100_000, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"node_texts_{uuid.uuid4().hex}"
    texts_of(docs, nodes, salt, buckets, text, doc_id).write.bucketBy(buckets, "place").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
