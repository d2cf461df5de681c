"""Operator 13, hard-negative mining with cover trees over norm-augmented candidates.

Components become whole numbers, floor(scale * x), and scores are inner products of whole numbers. Candidates get one more
coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so that all have the norm M, and an anchor q (that coordinate zero) at
distance d has the inner product (|q|^2 + M^2 - d^2) / 2. A node of a cover tree has a centre and a covering radius, the distance of the
farthest of its vectors; with the distance of q from the centre that bounds the inner products of all of them. Levels shrink the
radius by SHRINK.

The tree is built in two parts. The upper one has the levels over a bounded sample (SAMPLE vectors, by a hash of the id) and is
broadcast; every candidate goes to the leaf whose centre is nearest, and the leaves' radii are taken over all candidates. Leaves of
more than BLOCK vectors are dealt over blocks, so no task holds more. The lower part is built by the task that holds a block.
An anchor gets bounds from the sample, which it searches first: the k-th best that it has there. It is then sent to the
leaves that may hold something in its windows at or above its bounds, and goes down each block best first: nodes outside
all its windows, or below what it found already, are skipped, and what is in leaves is verified with whole numbers. Blocks and
their anchors are one sorted stream for each task, a block's vectors first; anchors are never gathered.

Two searches use it: an anchor's positives (same label, no window) and then its negatives (another label, one window for each
positive). Both are exact: bounds are widened by more than the rounding of doubles.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a vector that is
shorter than others counts as ending in zeros; other rows of the anchor's own vec_id aren't its positives; rows with a null
vec_id are candidates that come last among equals; equal rows are anchors once and candidates as often as they come; an empty
table gives no rows. Scores beyond 64 bits are cut to the largest long (or nearly the smallest).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkspark.llm.common import cut, stored, with_groups

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
SAMPLE, SAMPLE_FLOATS, BLOCK, TOP_LEAVES, LEAF, SHRINK = 2048, 1_000_000, 2048, 1024, 32, 1.3
#: Nodes or leaves that an anchor takes from its queue at once.
STEP = 64
NO_ID, LEAST, MOST = np.iinfo(np.int64).max, np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", every: int = 7) -> DataFrame:
    """(id, label, v) of the rows that take part: labels moved by one where `every` divides the id, whole components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("v")).where("label is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.coalesce(F.col("id") % every == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(fine).select("id", moved.alias("label"), F.transform("v", lambda x: F.floor(SCALE * x.cast("double")).cast("double")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix, shorter ones filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles while all sums are exact, else in Python's integers."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < 2**53:
        return (x @ q).astype(np.int64)
    exact = x.astype(object) @ np.array([int(a) for a in q], dtype=object) if len(x) else np.zeros(0, object)
    return np.array([max(LEAST + 1000, min(MOST, int(s))) for s in exact], dtype=np.int64)


@dataclass
class Tree:
    """Nodes in arrays: centre (a row of x), covering radius, children first..last of `nodes`, or the rows of a leaf."""

    x: np.ndarray
    lift: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    children: list[np.ndarray | None]
    rows: list[np.ndarray | None]

    @classmethod
    def build(cls, x: np.ndarray, most: float, leaf: int = LEAF) -> Tree:
        """Level by level: a node's rows are covered by centres within its radius / SHRINK, first come first, until a node is small or has no extent."""
        lift = np.column_stack([x, np.sqrt(np.maximum(0.0, most**2 - (x * x).sum(axis=1)))])
        square = (lift * lift).sum(axis=1)
        centre, radius, children, rows = [0], [0.0], [None], [np.arange(len(x))]
        open_nodes = [0] if len(x) else []
        while open_nodes:
            k = open_nodes.pop()
            own = rows[k]
            far = np.sqrt(np.maximum(0.0, square[own] + square[centre[k]] - 2 * lift[own] @ lift[centre[k]]))
            radius[k] = float(far.max())
            if len(own) <= leaf or radius[k] <= 0:
                continue
            within, rest, made = radius[k] / SHRINK, own, []
            while len(rest):
                away = np.sqrt(np.maximum(0.0, square[rest] + square[rest[0]] - 2 * lift[rest] @ lift[rest[0]]))
                near = away <= within
                near[0] = True
                made.append(len(centre))
                centre.append(int(rest[0]))
                radius.append(0.0)
                children.append(None)
                rows.append(rest[near])
                rest = rest[~near]
            children[k], rows[k] = np.array(made), None
            open_nodes += made
        return cls(x, lift, np.array(centre), np.array(radius), children, rows)

    def leaves(self, at_most: int) -> list[int]:
        """Nodes that cover all rows, the widest opened first, `at_most` of them if a node's children allow it."""
        found = [0]
        while True:
            wide = [k for k in found if self.children[k] is not None and len(found) - 1 + len(self.children[k]) <= at_most]
            if not wide:
                return found
            k = max(wide, key=lambda i: self.radius[i])
            found = [i for i in found if i != k] + self.children[k].tolist()


def bounds(q: np.ndarray, most: float, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that a vector of each node may have with q."""
    square = float(q @ q)
    d = np.sqrt(np.maximum(0.0, square + most**2 - 2 * centres[:, :-1] @ q))
    slack = 1.0 + 1e-9 * (square + most**2)
    return (square + most**2 - (d + radius) ** 2) / 2 - slack, (square + most**2 - np.maximum(0.0, d - radius) ** 2) / 2 + slack


class Best:
    """For each window [lo, hi] the k best (score, id) found, and the score that another must reach."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.least = np.maximum(lo, least)
        self.found: list[list[tuple[int, int]]] = [[] for _ in lo]

    def wants(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Nodes that some window may still take something from."""
        return ((upper[:, None] >= self.least) & (lower[:, None] <= self.hi)).any(axis=1)

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(len(self.lo)):
            fit = np.flatnonzero((score >= self.least[w]) & (score <= self.hi[w]))
            if not len(fit):
                continue
            fit = fit[np.lexsort((ids[fit], -score[fit]))][: self.k]
            kept = sorted(self.found[w] + list(zip((-score[fit]).tolist(), ids[fit].tolist(), strict=True)))[: self.k]
            self.found[w] = kept
            if len(kept) == self.k:
                self.least[w] = max(self.least[w], -kept[-1][0])


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, most: float, q: np.ndarray, own: tuple[int, int], same: bool, best: Best) -> None:
    """Best-first descent for the anchor q with own (id, label): what `best` wants of the tree's rows."""
    queue, upper = np.array([0]), np.array([np.inf])
    while len(queue):
        order = np.argsort(-upper, kind="stable")
        now, queue, upper = queue[order[:STEP]], queue[order[STEP:]], upper[order[STEP:]]
        opened = [tree.children[k] for k in now if tree.children[k] is not None]
        rows = [tree.rows[k] for k in now if tree.rows[k] is not None]
        if rows:
            at = np.concatenate(rows)
            at = at[(labels[at] == own[1]) & (ids[at] != own[0])] if same else at[labels[at] != own[1]]
            if len(at):
                best.take(products(tree.x[at], q), ids[at])
        if opened:
            new = np.concatenate(opened)
            low, high = bounds(q, most, tree.lift[tree.centre[new]], tree.radius[new])
            fit = best.wants(low, high)
            queue, upper = np.concatenate([queue, new[fit]]), np.concatenate([upper, high[fit]])
        if len(queue):
            fit = (upper[:, None] >= best.least).any(axis=1)
            queue, upper = queue[fit], upper[fit]


class Index:
    """The upper tree with its leaves' radii over all candidates, and the blocks of the leaves."""

    def __init__(self, rows: DataFrame):
        """rows: (id, label, v), computed before."""
        spark = rows.sparkSession
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("width")).first()
        self.n, self.width, self.most = facts.n, max(1, facts.width or 1), float(facts.most or 0.0) * (1 + 1e-9)
        if not self.n:
            return
        # a bounded sample: SAMPLE rows, SAMPLE_FLOATS components at most
        sample = rows.orderBy(F.xxhash64(F.lit(13), "id", "v"), "id").limit(max(2, min(SAMPLE, SAMPLE_FLOATS // self.width))).toArrow().combine_chunks()
        self.ids = sample.column("id").fill_null(NO_ID).to_numpy()
        self.labels = sample.column("label").to_numpy()
        self.tree = Tree.build(matrix(sample.column("v").combine_chunks() if isinstance(sample.column("v"), pa.ChunkedArray) else sample.column("v"), self.width), self.most)
        self.leaves = self.tree.leaves(max(1, min(TOP_LEAVES, self.n // BLOCK)))
        self.centres = self.tree.lift[self.tree.centre[self.leaves]]
        placed = stored(rows.mapInArrow(self.placing(), "id bigint, label bigint, v array<double>, leaf bigint, away double"), "placed")
        found = placed.groupBy("leaf").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("blocks")).collect()  # TOP_LEAVES rows at most
        self.radius = np.full(len(self.leaves), -1.0)
        for r in found:
            self.radius[r.leaf] = r.radius * (1 + 1e-9) + 1e-6
        self.full = np.flatnonzero(self.radius >= 0)
        self.blocks = spark.createDataFrame([(r.leaf, r.blocks) for r in found], "leaf bigint, blocks bigint")
        salt = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("blocks"))
        self.placed = with_groups(placed, self.blocks, "leaf").withColumn("block", salt).drop("blocks", "away")

    def placing(self):
        centres, most, width = self.centres, self.most, self.width
        square = (centres * centres).sum(axis=1)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4000):
                    part = b.slice(at, 4000)
                    x = matrix(part.column("v"), width)
                    lift = np.column_stack([x, np.sqrt(np.maximum(0.0, most**2 - (x * x).sum(axis=1)))])
                    away = np.maximum(0.0, (lift * lift).sum(axis=1)[:, None] + square - 2 * lift @ centres.T)
                    leaf = away.argmin(axis=1)
                    far = np.sqrt(away[np.arange(len(x)), leaf])
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("v"), pa.array(leaf.astype(np.int64)), pa.array(far)], ["id", "label", "v", "leaf", "away"])

        return place

    def found(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(key, window, score, id): for each window of anchors (key, id, label, v, lo, hi: arrays of longs) the k best rows of the
        same label or of another one with a score in it, fewer if there aren't as many."""
        tree, ids, labels, most, width = self.tree, self.ids, self.labels, self.most, self.width
        centres, radius, full = self.centres, self.radius, self.full

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    x, out, which, least = matrix(part.column("v"), width), [], [], []
                    own = list(zip(part.column("id").to_pylist(), part.column("label").to_pylist(), strict=True))
                    for i, (lo, hi) in enumerate(zip(part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True)):
                        best = Best(np.array(lo, np.int64), np.array(hi, np.int64), np.full(len(lo), LEAST), k)
                        search(tree, ids, labels, most, x[i], own[i], same, best)
                        low, high = bounds(x[i], most, centres[full], radius[full])
                        to = full[best.wants(low, high)]
                        out += to.tolist()
                        which += [i] * len(to)
                        least += [best.least.tolist()] * len(to)
                    taken = part.take(pa.array(which, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *(taken.column(c) for c in ("key", "id", "label", "v", "lo", "hi")), pa.array(least, pa.list_(pa.int64()))], ["leaf", "key", "id", "label", "v", "lo", "hi", "least"])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            at, block = None, None
            for b in batches:
                place = list(zip(b.column("leaf").to_pylist(), b.column("block").to_pylist(), strict=True))
                asks, x = b.column("asks").to_pylist(), matrix(b.column("v"), width)
                number, label = b.column("id").fill_null(NO_ID).to_numpy(), b.column("label").to_numpy()
                edges = [0, *(i for i in range(1, len(asks)) if place[i] != place[i - 1] or asks[i] != asks[i - 1]), len(asks)]
                out: list[tuple] = []
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if a == z:
                        continue
                    if place[a] != at:
                        at, held, block = place[a], [], None
                    if not asks[a]:
                        held.append((x[a:z], number[a:z], label[a:z]))
                        continue
                    if not held:
                        continue
                    if block is None:
                        own = [np.concatenate(c) for c in zip(*held, strict=True)]
                        block = (Tree.build(own[0], most), own[1], own[2])
                    lo, hi, least, key = (b.column(c).slice(a, z - a).to_pylist() for c in ("lo", "hi", "least", "key"))
                    for i in range(z - a):
                        best = Best(np.array(lo[i], np.int64), np.array(hi[i], np.int64), np.array(least[i], np.int64), k)
                        search(*block, most, x[a + i], (number[a + i], label[a + i]), same, best)
                        out += [(key[i], w, -s, None if n == NO_ID else n) for w, f in enumerate(best.found) for s, n in f]
                cols = zip(*out, strict=True) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "window", "score", "id"])

        longs = "array<bigint>"
        sent = anchors.select("key", "id", "label", "v", "lo", "hi").mapInArrow(route, f"leaf bigint, key bigint, id bigint, label bigint, v array<double>, lo {longs}, hi {longs}, least {longs}")
        sent = with_groups(sent, self.blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        none = [F.lit(None).cast(longs).alias(c) for c in ("lo", "hi", "least")]
        both = self.placed.select("leaf", "block", F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("key"), "id", "label", "v", *none)
        both = both.unionByName(sent.select("leaf", "block", F.lit(True).alias("asks"), "key", "id", "label", "v", "lo", "hi", "least"))
        both = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")
        met = both.mapInArrow(visit, "key bigint, window int, score bigint, id bigint")
        place = Window.partitionBy("key", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def part_of(score: Column, share: int, up: int) -> Column:
    """share hundredths of a long, rounded down (up: 0) or up (up: 99), in whole numbers throughout."""
    rest = F.pmod(score, F.lit(100))
    hundreds = F.call_function("div", score - rest, F.lit(100))
    return hundreds * share + F.call_function("div", rest * share + up, F.lit(100))


def hard_negatives(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: a condition on id."""
    spark = vectors.sparkSession
    rows = stored(whole(vectors, vec_id, label, embedding), "whole")
    index = Index(rows)
    if not index.n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    asked = cut(rows.where(anchors).distinct().withColumn("key", F.monotonically_increasing_id()))
    every = lambda x: F.array(F.lit(x).cast("bigint"))
    good = cut(index.found(asked.withColumns({"lo": every(int(LEAST) + 1000), "hi": every(int(MOST))}), POSITIVES, True))
    listed = good.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("good"))  # POSITIVES for each anchor
    windows = asked.join(listed, "key").withColumns({"lo": F.transform("good.score", lambda p: part_of(p, LOW, 99)), "hi": F.transform("good.score", lambda p: part_of(p, HIGH, 0))})
    bad = index.found(windows, NEGATIVES, False).select("key", "window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select("key", F.col("id").alias("anchor_id"))
    pairs = good.select("key", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(pairs, ["key", "window"]).join(ids, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10"""
