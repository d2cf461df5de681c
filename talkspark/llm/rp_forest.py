"""Operator 6, approximate nearest neighbours by largest inner product, with a forest of random-projection trees.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (zero for queries), which turns the
largest inner product into the nearest direction. TREES trees are fitted on a bounded sample: SAMPLE vectors by
lowest MD5 of the id, fewer if they'd have over SAMPLE_FLOATS components. A node splits its sample at the
median of the projection on the line through two random vectors of it; leaves have about LEAF of all vectors,
as far as the sample's size allows. Every vector is indexed in a leaf of each tree.

A query searches all trees through one priority queue, by the least margin on the way to a node, until the
leaves taken hold a budget of vectors (leaves of several trees count each) that grows slower than the table,
BUDGET * n^POWER. Queries meet leaves by (leaf, salt): leaves over CHUNK vectors are dealt over several salts and
their queries copied to each, so no task holds an unbounded leaf and none of its vectors is left out. First a query
meets the HOME leaves next to it; the worst of its best k there is a bound that what it finds in all its other
leaves must reach. The best candidates of all leaves are reranked by the exact inner product in double precision.

Equal vectors are indexed once, with as many of the least ids as a result can hold; ties go to smaller ids.
The budget reaches a recall of 0.9 on vectors without any structure; clustered ones need much less.

Defined results: rows with a null id, and vectors that are null, zero, or hold null or non-finite components
take no part, nor do vectors of another length than most; repeated ids count once, with the vector that comes
first in order; fewer candidates than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.llm.common import cut, stored

TREES, SAMPLE, SAMPLE_FLOATS, LEAF, CHUNK, SEED = 16, 61_440, 4_000_000, 256, 4000, 11
#: Vectors of the leaves that a query takes: BUDGET * n^POWER, MOST * n at most. Leaves that give the bound for the others.
BUDGET, POWER, MOST, HOME = 8.8, 0.75, 1.5, 8


class Forest:
    """Trees in arrays: node i of a tree has children 2i + 1 and 2i + 2; after `depth` levels come leaves."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.depth, self.trees, self.leaves = depth, trees, 1 << depth
        inner = self.leaves - 1
        self.normal = np.zeros((trees, inner, sample.shape[1]), np.float32)
        self.at = np.zeros((trees, inner), np.float32)
        self.share = np.zeros((trees, self.leaves))
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = parts.pop(node)
                way = np.zeros(sample.shape[1])
                for _ in range(5):
                    if len(rows) > 1 and not way.any():
                        a, b = r.choice(rows, 2, replace=False)
                        way = sample[a] - sample[b]
                if not way.any():
                    way = r.normal(size=sample.shape[1])
                self.normal[t, node] = way / np.linalg.norm(way)
                on = sample[rows] @ self.normal[t, node]
                self.at[t, node] = np.median(on) if len(rows) else 0
                right = on >= self.at[t, node]
                parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
            self.share[t] = [len(parts[inner + i]) / max(1, len(sample)) for i in range(self.leaves)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """[rows, trees, inner nodes]: how far on the right side of each split."""
        flat = self.normal.reshape(-1, self.normal.shape[2])
        return (x @ flat.T).reshape(len(x), self.trees, -1) - self.at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """[rows, trees]: number of the leaf over all trees."""
        m, out = self.margins(x), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (m[np.arange(len(x)), t, node] >= 0)
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def search(self, margins: np.ndarray, share: float) -> list[int]:
        """Leaves for one query: nodes of all trees in one queue, the least margin on the way decides."""
        queue = [(-math.inf, t, 0) for t in range(self.trees)]
        inner, taken, out = self.leaves - 1, 0.0, []
        while queue and taken < share:
            cost, t, node = heapq.heappop(queue)
            if node >= inner:
                out.append(t * self.leaves + node - inner)
                taken += self.share[t, node - inner]
                continue
            m = float(margins[t, node])
            heapq.heappush(queue, (max(cost, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(cost, -m), t, 2 * node + 2))
        return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def taking_part(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part, one row for each id."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where("id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "size")).alias("top")).select(F.col("top.size").alias("usual"))
    rows = rows.join(F.broadcast(usual)).where(F.size("v") == F.col("usual")).drop("usual")  # one row
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def meetings(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, kind, near): of each query in each (leaf, salt) the k + 1 best vectors that reach its bound.

    index: (leaf, salt, kind, v); asked: (leaf, salt, id, v, least). Both are sorted into one stream for each task, a
    leaf's vectors before its queries, so that a task holds CHUNK vectors or so at a time.
    """
    def best(x: np.ndarray, kind: np.ndarray, ids: np.ndarray, q: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        n = min(k + 1, len(kind))
        for start in range(0, len(ids), 500):
            near = q[start : start + 500] @ x.T
            found = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(kind) else np.tile(np.arange(n), (len(near), 1))
            value = np.take_along_axis(near, found, axis=1)
            # of what ties with the last place the smaller ids come along; kinds are in order
            for i in np.flatnonzero((near >= value.min(axis=1)[:, None]).sum(axis=1) > n):
                found[i] = np.lexsort((kind, -near[i]))[:n]
            value = np.take_along_axis(near, found, axis=1)
            fit = (value >= least[start : start + 500, None]).ravel()
            yield np.repeat(ids[start : start + 500], n)[fit], kind[found].ravel()[fit], value.ravel()[fit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            leaf, salt, asks, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "salt", "asks", "id"))
            x, least = matrix(b.column("v")), b.column("least").to_numpy(zero_copy_only=False)
            new = (np.diff(leaf) != 0) | (np.diff(salt) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            edges, out = [0, *(np.flatnonzero(new) + 1).tolist(), len(leaf)], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if at != (leaf[a], salt[a]):
                    at, held = (leaf[a], salt[a]), []
                if not asks[a]:
                    held.append((x[a:z], ids[a:z]))
                elif held:
                    if len(held) > 1:
                        held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    out += best(*held[0], ids[a:z], x[a:z], least[a:z])
            made = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["query_id", "kind", "near"])

    both = index.select("leaf", "salt", F.lit(False).alias("asks"), F.col("kind").alias("id"), "v", F.lit(0.0).alias("least"))
    both = both.unionByName(asked.select("leaf", "salt", F.lit(True).alias("asks"), "id", "v", "least"))
    both = both.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "asks", "id")
    return both.mapInArrow(run, "query_id bigint, kind bigint, near double")


def neighbours(vectors: DataFrame, every: int, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", budget: float = BUDGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = stored(taking_part(vectors, vec_id, embedding), "vectors")
    # equal vectors: the k + 1 least ids, one more for the query itself
    one = Window.partitionBy("v").orderBy("id")
    kinds = rows.withColumn("place", F.row_number().over(one)).where(F.col("place") <= k + 1)
    kinds = stored(kinds.groupBy("v").agg(F.min("id").alias("kind"), F.array_sort(F.collect_list("id")).alias("ids")), "kinds")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = kinds.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("width")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not facts.n:
        return empty
    size = max(2, min(SAMPLE, SAMPLE_FLOATS // facts.width))
    sample = kinds.select("v").orderBy(F.md5(F.col("kind").cast("string").cast("binary")), "kind").limit(size).toArrow()
    most = float(facts.most) * (1 + 1e-9)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, most**2 - (x * x).sum(axis=1)))])

    depth = max(0, min(round(math.log2(max(1, facts.n / LEAF))), int(math.log2(max(1, sample.num_rows / 16)))))
    # SAMPLE_FLOATS at most; a sixteenth as many nodes for each tree
    forest = Forest(lifted(matrix(sample.column("v"))), depth)
    share = min(MOST, budget * facts.n ** (POWER - 1))

    def place(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                leaf = forest.leaf_of(lifted(matrix(part.column("v"))))
                at = pa.array(np.repeat(np.arange(part.num_rows), forest.trees))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), part.column("kind").take(at), part.column("v").take(at)], ["leaf", "kind", "v"])

    def asking(home: bool):
        def ask(batches):
            for b in batches:
                for start in range(0, b.num_rows, 500):
                    part = b.slice(start, 500)
                    x = matrix(part.column("v"))
                    m = forest.margins(np.column_stack([x, np.zeros(len(x))]))
                    found = [forest.search(m[i], share) for i in range(len(x))]
                    found = [f[:HOME] if home else f[HOME:] for f in found]
                    at = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays([pa.array([y for f in found for y in f], pa.int64()), part.column("id").take(at), part.column("v").take(at)], ["leaf", "id", "v"])
        return ask

    kind_of_v = f"leaf bigint, kind bigint, v {dict(kinds.dtypes)['v']}"
    index = stored(kinds.select("kind", "v").mapInArrow(place, kind_of_v), "index")
    queries = rows.where(F.col("id") % every == 0)
    salts = cut(index.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts")))  # a row for each leaf of the forest
    dealt = index.join(salts, "leaf").withColumn("salt", F.pmod(F.crc32(F.col("kind").cast("string").cast("binary")), F.col("salts")).cast("bigint"))

    def found(home: bool, bounds: DataFrame | None = None) -> DataFrame:
        asked = queries.mapInArrow(asking(home), kind_of_v.replace("kind", "id"))
        asked = asked.join(salts, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)))
        least = F.lit(-1e300)
        if bounds is not None:
            asked, least = asked.join(bounds, "id", "left"), F.coalesce("bound", F.lit(-1e300))
        return meetings(dealt, asked.withColumn("least", least), k).groupBy("query_id", "kind").agg(F.max("near").alias("near"))

    by_near = Window.partitionBy("query_id").orderBy(F.desc("near"), "kind")
    near = cut(found(True).withColumn("place", F.row_number().over(by_near)).where(F.col("place") <= k + 6))
    # k + 1 others at least reach the bound, one of them perhaps the query itself; a little less, as sums may be rounded otherwise
    bounds = near.where(F.col("place") == k + 2).select(F.col("query_id").alias("id"), (F.col("near") - 1e-9 * (1 + F.abs("near"))).alias("bound"))
    met = near.select("query_id", "kind", "near").unionByName(found(False, bounds)).groupBy("query_id", "kind").agg(F.max("near").alias("near"))
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "kind")
    met = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 6).select("query_id", "kind")
    exact = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    found = met.join(kinds, "kind").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    found = found.select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20))
