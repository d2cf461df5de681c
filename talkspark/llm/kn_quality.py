"""Operator 5, quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model has byte n-grams up to ORDER over texts with A-Z lower-cased, digits as one digit and each text
between line feeds. It is trained on all trusted documents (label quality 1 and toxic not 1): counts of the
highest order, continuation counts below, the three discounts of each order from its counts of counts.

Every document is scored held out: a hash of its text deals it to one of FOLDS folds, and the model of a fold is
trained on the trusted documents of all other folds. So trusted documents aren't scored by counts of their own
(or of their exact copies), and their scores can be compared with those of all other documents.

Scoring joins counts in shards instead of sending the model to tasks. Documents are packed into blocks of
about BLOCK bytes (rows in compressed Arrow form); each block gives its distinct n-grams once; those join
the tables of the model order by order, hashed by n-gram, which gives log probabilities; (block, n-gram,
log probability) meet their block again, and every document is scored there. So a join carries the distinct
n-grams of blocks, not one row for each position of the corpus.

A document's score is its mean negative log probability for each byte, with PRIOR bytes of its language's
mean on trusted text added, so short texts aren't judged by a few letters; perplexity is its exponential.
The threshold of a language is the QUANTILE of the held-out scores of trusted documents, so about that share of
clean documents stays, and FLOOR at least; languages with under LEAST trusted documents use the quantile of all.
Documents over it are rejected.

Defined results: a null or empty text has perplexity null and is kept (nothing speaks against it); a null lang
is a language of its own; null doc_id is trusted by no label; repeated rows are scored one by one; no trusted
text at all gives perplexity null and keeps every row; an empty table gives no rows; other columns pass
through, and an input column named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.llm.bpe import slices, with_column
from talkspark.llm.common import cut, give_back, shared_dir, shuffled, stored, tidy, with_groups

ORDER, PRIOR, QUANTILE, LEAST, FOLDS = 4, 40, 0.99, 50, 4
#: Thresholds are never lower (nats a byte): trusted texts all alike have no spread. On sf0.1 they are 1.67 and more.
FLOOR = 0.2
#: Bytes of text in a block, and of those worked at once.
BLOCK, PART = 16_000_000, 1_000_000
#: Lower-cased letters, one digit.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
MASK = (1 << (8 * ORDER)) - 1
#: Bytes of n-grams whose table may be broadcast: 65,536 rows for each fold at most. Their keys are too few to shuffle by.
SMALL = 2


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every byte of the texts, as a number, and where each text ends.

    ORDER - 1 line feeds stand before each text and one ends it.
    """
    lead = b"\n" * (ORDER - 1)
    data = FOLD[np.frombuffer(b"".join(lead + t + b"\n" for t in texts), dtype=np.uint8)].astype(np.int64)
    grams = np.zeros(len(data), np.int64)
    for j in range(ORDER):
        grams[j:] |= data[: len(data) - j] << (8 * j)
    ends = np.cumsum([len(t) + ORDER for t in texts])
    keep = np.ones(len(data), bool)
    begins = np.concatenate([[0], ends[:-1]])
    for j in range(ORDER - 1):
        keep[begins + j] = False
    return grams[keep], ends - (ORDER - 1) * np.arange(1, len(texts) + 1)


def looked_up(rows: DataFrame, n: int) -> DataFrame:
    """A table of n-grams of n bytes as the side of a join that is looked up."""
    return rows if n <= SMALL else shuffled(rows)


class Model:
    """Tables of the model, one pair for each order k: grams (gram, own) with the discounted probability of seen
    n-grams without lower orders, and contexts (context, back) with the weight that goes to the lower order.

    highest has gram and n; with a column fold, each fold is a model of its own.
    """

    def __init__(self, highest: DataFrame):
        self.by = [c for c in highest.columns if c == "fold"]
        self.grams: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}
        counts = cut(highest)
        for k in range(ORDER, 0, -1):
            c = F.col("n")
            # counts of counts decide the discounts: one row for each fold, joined by broadcast
            d = counts.groupBy(*self.by).agg(*(F.count(F.when(c == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)))
            y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
            # greatest and least skip nulls, so what isn't defined needs the condition
            raw = lambda i: i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))  # noqa: E731,B023
            d = d.select(*self.by, *(F.when(raw(i).isNotNull(), F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), raw(i)))).otherwise(F.lit(0.5 * i)).alias(f"d{i}") for i in (1, 2, 3)))
            cell = counts.join(F.broadcast(d), self.by or None).withColumn("context", F.shiftright("gram", 8))
            less = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
            cell = cell.select(*self.by, "gram", "context", "n", less.alias("less"))
            total = cell.groupBy(*self.by, "context").agg(F.sum("n").alias("total"), F.sum("less").alias("lost"))
            own = cell.join(looked_up(total, k - 1), [*self.by, "context"]).select(*self.by, "gram", ((F.col("n") - F.col("less")) / F.col("total")).alias("own"))
            self.grams[k] = cut(own)
            self.contexts[k] = cut(total.select(*self.by, "context", (F.col("lost") / F.col("total")).alias("back")))
            if k > 1:  # continuation counts: in how many contexts the shorter n-gram stands
                mask = (1 << (8 * (k - 1))) - 1
                counts = cut(counts.groupBy(*self.by, F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n")))

    def log_probabilities(self, asked: DataFrame) -> DataFrame:
        """(gram, logp) for distinct grams: p_k = own_k + back_k * p_(k-1), from a uniform order 0 upwards."""
        out = asked.select(*self.by, "gram", F.lit(1.0 / 256).alias("p"))
        for k in range(1, ORDER + 1):
            mask = (1 << (8 * k)) - 1
            out = out.withColumns({"g": F.col("gram").bitwiseAND(F.lit(mask)), "c": F.shiftright(F.col("gram").bitwiseAND(F.lit(mask)), 8)})
            out = out.join(looked_up(self.grams[k].withColumnRenamed("gram", "g"), k), [*self.by, "g"], "left")
            out = out.join(looked_up(self.contexts[k].withColumnRenamed("context", "c"), k - 1), [*self.by, "c"], "left")
            out = out.select(*self.by, "gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
        return out.select(*self.by, "gram", F.log("p").alias("logp"))


def packed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Blocks of rows of one fold, about BLOCK bytes of text each: (block, fold, ids, rows), rows in compressed Arrow form.

    The block is a hash of the content, so a task that is run again gives the same block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        held: list[list[pa.RecordBatch]] = [[] for _ in range(FOLDS)]
        size = [0] * FOLDS

        def block(fold: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[fold][0].schema, options=options) as writer:
                for b in held[fold]:
                    writer.write_batch(b)
            data = sink.getvalue().to_pybytes()
            key = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
            ids = [i for b in held[fold] for i in b.column(doc_id).to_pylist() if i is not None]
            held[fold], size[fold] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([fold], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "fold", "ids", "rows"]
            )

        for batch in batches:
            for fold in range(FOLDS):
                own = batch.filter(pa.compute.equal(batch.column("__fold"), fold))
                for start, n in slices(own.column(text), PART):
                    part = own.slice(start, n)
                    held[fold].append(part)
                    size[fold] += part.column(text).nbytes
                    if size[fold] >= BLOCK:
                        yield block(fold)
        for fold in range(FOLDS):
            if held[fold]:
                yield block(fold)

    folded = docs.withColumn("__fold", F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int"))
    return folded.mapInArrow(tidy(run), "block bigint, fold int, ids array<bigint>, rows binary")


def block_texts(data: bytes, text: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """Of each batch of a block: the batch, the rows that have a text, and those texts."""
    for batch in pa.ipc.open_stream(data):
        texts = batch.column(text).to_pylist()
        rows = [i for i, t in enumerate(texts) if t]
        yield batch, rows, [texts[i].encode() for i in rows]


def block_grams(blocks: DataFrame, trusted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(block, fold, gram, n): the distinct n-grams of each block, n times in its trusted texts. trusted: (at_block, id)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").combine_chunks() if right.num_rows else pa.array([], pa.int64())
        times, keys, counts = left.num_rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for data in left.column("rows").to_pylist()[:1]:  # equal blocks have equal rows
            for batch, rows, texts in block_texts(data, text):
                if not rows:
                    continue
                good = pa.compute.is_in(batch.column(doc_id), value_set=ids).to_numpy(zero_copy_only=False)[rows]
                at, ends = codes(texts)
                new, where = np.unique(at, return_inverse=True)
                weight = np.repeat(good, np.diff(ends, prepend=0))
                more = np.bincount(where, weights=weight, minlength=len(new)).astype(np.int64)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, more]), minlength=len(keys)).astype(np.int64)
        give_back()
        block, fold = (left.column(c)[0].as_py() if times else 0 for c in ("block", "fold"))
        return pa.table({"block": pa.array(np.full(len(keys), block)), "fold": pa.array(np.full(len(keys), fold, np.int32)), "gram": pa.array(keys), "n": pa.array(counts * times)})

    return blocks.groupBy("block").cogroup(trusted.groupBy("at_block")).applyInArrow(run, "block bigint, fold int, gram bigint, n bigint")


def block_scores(blocks: DataFrame, known: DataFrame, fields: list[T.StructField], text: str) -> DataFrame:
    """The rows of blocks without the text, with nll and n_bytes. known: (at_block, gram, logp)."""
    names = [f.name for f in fields]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, logp = right.column("gram").to_numpy(), right.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
        out = []
        for data in left.column("rows").to_pylist()[:1]:
            for batch, rows, texts in block_texts(data, text):
                nll, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                if rows:
                    at, ends = codes(texts)
                    sums = np.concatenate([[0], np.cumsum(logp[np.searchsorted(keys, at)])])
                    begins = np.concatenate([[0], ends[:-1]])
                    nll[rows] = sums[begins] - sums[ends]
                    size[rows] = ends - begins
                part = with_column(batch.select(names), "nll", pa.array(nll))
                out.append(with_column(part, "n_bytes", pa.array(size)))
        give_back()
        return pa.Table.from_batches(out * left.num_rows)

    schema = T.StructType([*fields, T.StructField("nll", T.DoubleType()), T.StructField("n_bytes", T.LongType())])
    return blocks.groupBy("block").cogroup(known.groupBy("at_block")).applyInArrow(run, schema)


def held_out(counts: DataFrame) -> DataFrame:
    """Counts (fold, gram, n) to those of each fold's model: the sums over all other folds."""
    others = counts.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    return others.where("fold <> own").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the text, with nll (sum of negative log probabilities) and n_bytes, under the model of the
    trusted documents of other folds (ids in the column doc_id of trusted).

    Blocks are a table bucketed by block, so they lie on disk once and aren't shuffled for either pass.
    """
    spark = docs.sparkSession
    docs = docs.drop("nll", "n_bytes", "trusted", "__fold")
    fields = [f for f in docs.schema.fields if f.name != text]
    buckets = min(100_000, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"kn_blocks_{uuid.uuid4().hex}"
    try:
        packed(docs, text, doc_id).write.bucketBy(buckets, "block").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        blocks = spark.table(name)
        ids = blocks.select(F.col("block").alias("at_block"), F.explode("ids").alias("id")).distinct()
        good = ids.join(shuffled(trusted.select(F.col(doc_id).cast("long").alias("id"))), "id").select("at_block", "id")
        made = stored(block_grams(blocks.select("block", "fold", "rows"), good, text, doc_id), "grams")
        model = Model(held_out(made.where("n > 0").groupBy("fold", "gram").agg(F.sum("n").alias("n"))))
        known = made.select(F.col("block").alias("at_block"), "fold", "gram").join(shuffled(model.log_probabilities(made.select("fold", "gram").distinct())), ["fold", "gram"]).drop("fold")
        scores = stored(block_scores(blocks.select("block", "rows"), known, fields, text), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return scores


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids whose labels all say quality 1 and none says toxic."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(good).alias("good")).where("good").select(doc_id)


def judged(scores: DataFrame, lang: str = "lang") -> DataFrame:
    """Scores with perplexity, threshold (also a perplexity) and kept. scores needs nll, n_bytes, trusted."""
    total = lambda k: F.sum(F.when(F.col("trusted"), F.col(k)))
    one = scores.withColumn("__lang", F.coalesce(F.concat(F.lit("+"), F.col(lang)), F.lit("-")))
    means = one.groupBy("__lang").agg(F.try_divide(total("nll"), total("n_bytes")).alias("__mean"))
    whole = one.agg(F.try_divide(total("nll"), total("n_bytes")).alias("__all"))
    one = with_groups(one, cut(means), "__lang").join(F.broadcast(whole))
    mean = F.coalesce("__mean", "__all")
    one = one.withColumn("__score", F.when(F.col("n_bytes") > 0, (F.col("nll") + PRIOR * mean) / (F.col("n_bytes") + PRIOR)))
    fine = F.when(F.col("trusted"), F.col("__score"))
    # one score without end more, so of n scores the ceil((n + 1) * QUANTILE)-th is the limit: new clean documents stay as often
    beyond = F.lit(float("inf")).alias("__fine")
    fines = one.select("__lang", fine.alias("__fine")).where(F.col("__fine").isNotNull())
    limited = lambda by: F.least(F.percentile_approx("__fine", QUANTILE, 10000), F.max(F.when(F.col("__fine") != float("inf"), F.col("__fine")))).alias(by)
    own = fines.unionByName(fines.select("__lang").distinct().select("__lang", beyond)).groupBy("__lang").agg(limited("__own"), (F.count("*") - 1).alias("__n"))
    every = fines.select("__fine").unionByName(scores.sparkSession.range(1).select(beyond)).agg(limited("__every"))
    one = with_groups(one, cut(one.select("__lang").distinct().join(own, "__lang", "left")), "__lang").join(F.broadcast(every))
    limit = F.when(F.col("__n") >= LEAST, F.col("__own")).otherwise(F.col("__every"))
    limit = F.when(limit.isNotNull(), F.greatest(limit, F.lit(FLOOR)))
    one = one.withColumns({"perplexity": F.exp("__score"), "threshold": F.exp(limit), "kept": F.coalesce(F.col("__score") <= limit, F.lit(True))})
    return one.drop("__lang", "__mean", "__all", "__score", "__own", "__n", "__every")


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs without the text, with nll, n_bytes, trusted, perplexity, threshold and kept."""
    trusted = cut(trusted_ids(labels, doc_id))
    scores = scored(docs, trusted, text, doc_id)
    scores = scores.join(shuffled(trusted.select(F.col(doc_id).alias("__id"))), F.col(doc_id) == F.col("__id"), "left")
    return judged(cut(scores.withColumn("trusted", F.col("__id").isNotNull()).drop("__id")), lang)


def op5_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "trusted", "kept")
