"""Voice prints: registry of members, centroids, nearest voice, and changes to the registry.

Members: namespace, name, job_id, speaker_id, embedding, weight, added. A namespace has one width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions.scalars import blank_to_null, cosine, unit

THRESHOLD = 0.75
#: What a task holds of voices (4096 of 256 doubles are 8 MB) and of prints.
VOICES_PER_BLOCK, PRINTS_PER_TASK = 4096, 50_000


def centroids(members: DataFrame) -> DataFrame:
    """(namespace, name, centroid): the unit vector of the weighted mean of unit vectors.

    Sums are by (name, place in the vector), so a popular name is summed in many tasks. Widths must agree.
    """
    parts = members.select("namespace", "name", "weight", F.size("embedding").alias("width"), F.posexplode(unit(F.col("embedding"))).alias("place", "x"))
    sums = parts.groupBy("namespace", "name", "place").agg(F.sum(F.col("x") * F.col("weight")).alias("x"), F.sum("weight").alias("w"), F.min("width").alias("low"), F.max("width").alias("high"))
    whole = sums.groupBy("namespace", "name").agg(
        F.array_sort(F.collect_list(F.struct("place", (F.col("x") / F.col("w")).alias("x")))).alias("v"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    checked = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("embedding widths differ within a name")).cast("array<double>")).otherwise(unit(F.col("v.x")))
    return whole.select("namespace", "name", checked.alias("centroid"))


class Vectors:
    """A column of vectors as flat numbers, with the size of each."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks()
        self.sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        return self.flat[self.starts[at][:, None] + np.arange(width)]


def best_voice(prints: DataFrame, voices: DataFrame, print_id: str = "print_id") -> DataFrame:
    """prints with name and score of the nearest voice of their namespace; ties to the first name in order.

    Voices are dealt over blocks of about VOICES_PER_BLOCK by a hash of the name, prints over salts of about
    PRINTS_PER_TASK; each block meets each salt in one cogroup and is one matrix product there. Prints match
    only voices of their width.
    """
    parts = lambda df, n, to: df.groupBy("namespace").agg(F.ceil(F.count("*") / n).alias(to))
    salts, blocks = parts(prints, PRINTS_PER_TASK, "salts"), parts(voices, VOICES_PER_BLOCK, "blocks")
    both = salts.join(blocks, "namespace")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    asked = prints.select("namespace", print_id, "embedding").join(both, "namespace")
    asked = asked.withColumn("p_salt", F.pmod(F.xxhash64(print_id), F.col("salts"))).select(F.col("namespace").alias("p_namespace"), each("blocks").alias("p_block"), "p_salt", print_id, "embedding")
    known = voices.join(both, "namespace").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    known = known.select("namespace", "block", each("salts").alias("salt"), "name", "centroid")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"namespace": [], print_id: [], "name": [], "score": []}
        names, known, asked_in = right.column("name").to_pylist(), Vectors(right.column("centroid")), Vectors(left.column("embedding"))
        order = np.array(sorted(range(len(names)), key=names.__getitem__), dtype=np.int64)
        ids, space = left.column(print_id).to_pylist(), left.column("p_namespace").to_pylist()
        for width in set(known.sizes.tolist()) - {0}:
            own = order[known.sizes[order] == width]
            m = known.rows(own, width)
            lengths = np.linalg.norm(m, axis=1)
            rows = np.flatnonzero(asked_in.sizes == width)
            for start in range(0, len(rows), 1000):
                some = rows[start : start + 1000]
                x = asked_in.rows(some, width)
                size = np.linalg.norm(x, axis=1)[:, None] * lengths[None]
                near = np.where(size > 0, x @ m.T / np.maximum(size, 1e-300), -1.0)
                k = near.argmax(axis=1)
                out["namespace"] += [space[i] for i in some]
                out[print_id] += [ids[i] for i in some]
                out["name"] += [names[own[j]] for j in k]
                out["score"] += near[np.arange(len(some)), k].tolist()
        kinds = {"namespace": pa.string(), print_id: left.schema.field(print_id).type, "name": pa.string(), "score": pa.float64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    met = asked.groupBy("p_namespace", "p_block", "p_salt").cogroup(known.groupBy("namespace", "block", "salt"))
    found = met.applyInArrow(run, f"namespace string, {print_id} {dict(prints.dtypes)[print_id]}, name string, score double")
    best = found.groupBy("namespace", print_id).agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return prints.join(best.select("namespace", print_id, "score", F.col("b.name").alias("name")), ["namespace", print_id], "left")


def resolved(matched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Matches with resolved: the name where the score reaches the threshold."""
    return matched.withColumn("resolved", F.when(F.col("score") >= threshold, F.col("name")))


def growing_prints(windows: DataFrame) -> DataFrame:
    """windows (namespace, recording, voice, window_ix, print_id, embedding, weight), the print each time that of all windows so far.

    Sums run by place in the vector, so that a voice of many windows is summed in as many tasks as it has places.
    """
    cells = windows.select("namespace", "recording", "voice", "window_ix", "print_id", "weight", F.posexplode(unit(F.col("embedding"))).alias("place", "x"))
    so_far = Window.partitionBy("namespace", "recording", "voice", "place").orderBy("window_ix", "print_id").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("x", F.sum(F.col("x") * F.col("weight")).over(so_far))
    whole = cells.groupBy("namespace", "recording", "voice", "window_ix", "print_id").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v"))
    return whole.select("namespace", "recording", "voice", "window_ix", "print_id", unit(F.col("v.x")).alias("embedding"))


def suggested(matched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Matches of live voices (given: the name that a voice has, or null) with suggested: another name that reaches the threshold."""
    other = F.col("given").isNull() | (F.col("name") != F.col("given"))
    return matched.withColumn("suggested", F.when((F.col("score") >= threshold) & other, F.col("name")))


def similarity_to(prints: DataFrame, voices: DataFrame) -> DataFrame:
    """prints (with `asked`, a name) with similarity to that name's voice; null where it is unknown."""
    v = voices.select("namespace", F.col("name").alias("asked"), "centroid")
    return prints.join(v, ["namespace", "asked"], "left").withColumn("similarity", F.when(F.col("centroid").isNotNull(), cosine(F.col("embedding"), F.col("centroid")))).drop("centroid")


def folded(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members with new ones (same columns): a print of a (job, speaker) replaces the earlier one in that name, the
    last of several counts (by added); prints without a job pile up; empty names and prints are skipped."""
    fine = new.withColumn("name", blank_to_null(F.col("name"))).where("name is not null AND size(embedding) > 0")
    fine = fine.withColumn("embedding", unit(F.col("embedding")))
    key = ["namespace", "name", "job_id", "speaker_id"]
    known = fine.where("job_id is not null")
    last = known.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("added")))).where("n = 1").drop("n")
    kept = members.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last).unionByName(fine.where("job_id is null"))


def unfolded(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without those of gone (namespace, name, job_id, speaker_id); a name goes with its last member."""
    return members.join(gone, ["namespace", "name", "job_id", "speaker_id"], "left_anti")


def renamed(members: DataFrame, source: str, target: str, namespace: str) -> DataFrame:
    """Members with one voice merged into another."""
    hit = (F.col("namespace") == namespace) & (F.col("name") == source)
    return members.withColumn("name", F.when(hit, F.lit(target)).otherwise(F.col("name")))


def deleted(members: DataFrame, names: DataFrame) -> DataFrame:
    """Members without the voices of names (namespace, name)."""
    return members.join(names, ["namespace", "name"], "left_anti")


MEMBER = ["namespace", "name", "job_id", "speaker_id"]


def members_after(log: DataFrame) -> DataFrame:
    """Members after a log of changes (seq, op, namespace, name, job_id, speaker_id, embedding, weight): fold, unfold, and delete of a
    whole voice (no job and speaker). The last change of a member counts, and a deletion counts against all that is earlier; what
    was taken away stays as a tombstone in the log, so that an old fold that comes again changes nothing."""
    own = log.where("op <> 'delete'").groupBy(*MEMBER).agg(F.max_by(F.struct("op", "seq", "embedding", "weight"), F.struct("seq", F.col("op") == "unfold")).alias("last"))
    ends = log.where("op = 'delete'").groupBy("namespace", "name").agg(F.max("seq").alias("ended"))
    kept = own.join(ends, ["namespace", "name"], "left").where((F.col("last.op") == "fold") & (F.col("ended").isNull() | (F.col("last.seq") > F.col("ended"))))
    return kept.select(*MEMBER, "last.embedding", "last.weight", F.col("last.seq").alias("added"))


def print_sums(members: DataFrame) -> DataFrame:
    """(namespace, name, place, x, w, n): what centroids are made of, by place in the vector, so that a voice of many members is summed in many tasks."""
    cells = members.select("namespace", "name", "weight", F.posexplode(unit(F.col("embedding"))).alias("place", "u"))
    return cells.groupBy("namespace", "name", "place").agg(F.sum(F.col("u") * F.col("weight")).alias("x"), F.sum("weight").alias("w"), F.count("*").alias("n"))


def changed_sums(sums: DataFrame, gone: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """sums after members went and came: only the names that these touch are read again; a voice goes with its last member."""
    minus = print_sums(gone).select("namespace", "name", "place", *((-F.col(c)).alias(c) for c in ("x", "w", "n")))
    delta = minus if new is None else minus.unionByName(print_sums(new))
    touched = delta.select("namespace", "name").distinct()
    same = sums.join(touched, ["namespace", "name"], "left_anti")
    moved = sums.join(touched, ["namespace", "name"], "left_semi").unionByName(delta).groupBy("namespace", "name", "place").agg(*(F.sum(c).alias(c) for c in ("x", "w", "n")))
    return same.unionByName(moved.where("n > 0"))


def centroids_of(sums: DataFrame) -> DataFrame:
    whole = sums.groupBy("namespace", "name").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("x") / F.col("w")).alias("x")))).alias("v"))
    return whole.select("namespace", "name", unit(F.col("v.x")).alias("centroid"))


def unassigned(labels: DataFrame, members: DataFrame, who: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels (job_id, speaker, label) without the speakers of who (job_id, speaker), and the members that they taught: the
    print leaves the voice with the name, or it would go on pulling at it."""
    taken = labels.join(who, ["job_id", "speaker"], "left_semi")
    taught = taken.select(F.col("label").alias("name"), "job_id", F.col("speaker").alias("speaker_id"))
    return labels.join(who, ["job_id", "speaker"], "left_anti"), members.join(taught, ["name", "job_id", "speaker_id"], "left_semi")


def with_provenance(members: DataFrame, jobs: DataFrame) -> DataFrame:
    """Members with their job's source and whether they can be played: the job is still there."""
    j = jobs.select("job_id", F.col("dir").alias("source"), F.lit(True).alias("there"))
    return members.join(j, "job_id", "left").withColumn("playable", F.coalesce("there", F.lit(False)) & F.col("speaker_id").isNotNull()).drop("there")


def renamed_in_labels(labels: DataFrame, source: str, target: str) -> DataFrame:
    """Jobs with a map of labels, where one name is another everywhere; only jobs that change."""
    hit = F.array_contains(F.map_values("labels"), source)
    return labels.where(hit).withColumn("labels", F.transform_values("labels", lambda k, v: F.when(v == source, F.lit(target)).otherwise(v)))


def collapsed_channel(turns: DataFrame, prints: DataFrame, channel: str) -> tuple[DataFrame, DataFrame]:
    """Turns and prints with all speakers of a channel (a prefix such as L_) as the smallest of them.

    Timing stays. The print is the mean of the speakers' raw prints weighted by talk time, each counting one
    where nobody talked.
    """
    one = F.col("speaker").startswith(channel)
    least = turns.where(one).groupBy("job_id").agg(F.min("speaker").alias("to"))
    new = turns.join(least, "job_id", "left").withColumn("speaker", F.when(one, F.col("to")).otherwise(F.col("speaker"))).drop("to")
    talk = turns.where(one).groupBy("job_id", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("talk"))
    own = prints.where(F.col("speaker").startswith(channel)).join(talk, ["job_id", "speaker"], "left").join(least, "job_id")
    own = own.withColumn("total", F.sum("talk").over(Window.partitionBy("job_id")))
    own = own.withColumn("w", F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("talk", F.lit(0)).cast("double")).otherwise(1.0))
    cells = own.select("job_id", "to", "w", F.posexplode("embedding").alias("place", "x")).groupBy("job_id", "to", "place").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    mean = cells.groupBy("job_id", F.col("to").alias("speaker")).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v")).select("job_id", "speaker", F.col("v.x").alias("embedding"))
    others = prints.where(~F.col("speaker").startswith(channel)).select("job_id", "speaker", F.col("embedding").cast("array<double>").alias("embedding"))
    return new, others.unionByName(mean)


def channels_united(left: DataFrame, right: DataFrame) -> DataFrame:
    """Turns of two channels as one table, speakers with the prefix of their channel."""
    mark = lambda df, p: df.withColumn("speaker", F.concat(F.lit(p), F.col("speaker")))
    return mark(left, "L_").unionByName(mark(right, "R_"))
