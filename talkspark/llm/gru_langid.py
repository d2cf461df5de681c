"""Operator 9, language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text (A-Z lower-cased) in segments of SEGMENT bytes, in both directions, and
labels every position; the position probabilities of all segments of a document are averaged, and the largest
mean gives the language and the score. It is trained in numpy by backpropagation through time with Adam.

Training rows are those with text and lang whose crc32(doc_id) mod 5 isn't 0. The fit uses a bounded sample of
them: DOCS documents of each language, lowest MD5 of doc_id first, and PIECES passages of SEGMENT characters
from each; every other step covers all rows. Predictions use the text only.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text when there is
nothing to learn from; a null doc_id is never held out and not learned from; repeated rows are judged one by
one; an empty table gives no rows; other columns pass through, and an input column named like an output is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.llm.common import cut, tidy, with_groups

#: Segment length in bytes; hidden units of each direction; sample of each language; folds and the one held out.
SEGMENT, HIDDEN, DOCS, PIECES, FOLDS = 64, 8, 400, 8, 5
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.02, 7
#: Segments that are read side by side; bytes of text worked at once.
WIDE, SLICE = 2048, 8_000_000
PAD = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def segments(texts: list[bytes], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Codes [segments, length], the last segment of a text padded, and the text of each segment."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // length)
    flat = np.full(int(count.sum()) * length, PAD, dtype=np.int16)
    data = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    begins = np.cumsum(count * length) - count * length
    flat[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))] = data
    return flat.reshape(-1, length), np.repeat(np.arange(len(texts)), count)


class Network:
    """One layer of gated recurrent units in each direction and a softmax over both at every position.

    For each direction: `in` [3H, 257] byte -> update, reset and candidate inputs; `rec` [2H, H] and `cand`
    [H, H] for the state. Padding has an update input so large that the state stays as it is.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.p = {"out": np.zeros((len(labels), 2 * hidden), np.float32), "bias": np.zeros((len(labels), 1), np.float32)}
        for d in "fb":
            self.p[f"in{d}"] = r.normal(0, 0.5, (3 * hidden, 257)).astype(np.float32)
            self.p[f"rec{d}"] = r.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32)
            self.p[f"cand{d}"] = r.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
        self.hold()

    def hold(self) -> None:
        for d in "fb":
            self.p[f"in{d}"][:, PAD] = 0
            self.p[f"in{d}"][: self.h, PAD] = 60

    def states(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States [time, H, n] of one direction; keep gets what the backward pass needs."""
        n, length = codes.shape
        h, p = self.h, self.p
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5  # a sigmoid as 0.5 + 0.5 tanh(x / 2)
        table, rec, cand = p[f"in{d}"] * half, p[f"rec{d}"] * np.float32(0.5), p[f"cand{d}"]
        out = np.empty((length, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        by_time = np.ascontiguousarray(codes.T)
        x, both = np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            np.take(table, by_time[t], axis=1, out=x, mode="clip")
            np.matmul(rec, state, out=both)
            both += x[: 2 * h]
            np.tanh(both, out=both)
            both *= np.float32(0.5)
            both += np.float32(0.5)
            gated = both[h:] * state
            new = cand @ gated
            new += x[2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state, both.copy(), gated, new))
            state = new + both[:h] * (state - new)
            out[t] = state
        return out

    def position_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """[labels, time, n]."""
        h = self.h
        forward, backward = self.states(codes, "f"), self.states(codes, "b")
        logits = np.einsum("kh,thn->ktn", self.p["out"][:, :h], forward, optimize=True)
        logits += np.einsum("kh,thn->ktn", self.p["out"][:, h:], backward, optimize=True)
        logits += self.p["bias"][:, :, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def gradients(self, codes: np.ndarray, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions, and its gradients by backpropagation through time."""
        h, p = self.h, self.p
        n, length = codes.shape
        kept: dict[str, list] = {"f": [], "b": []}
        s = {d: self.states(codes, d, kept[d]) for d in "fb"}
        both = np.concatenate([s["f"], s["b"]], axis=1)
        logits = np.einsum("kh,thn->tkn", p["out"], both, optimize=True) + p["bias"][None]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        mask = (codes.T != PAD).astype(np.float32)
        total = mask.sum()
        loss = -float((np.log(prob[:, wanted, np.arange(n)] + 1e-9) * mask).sum() / total)
        prob[:, wanted, np.arange(n)] -= 1
        prob *= (mask / total)[:, None, :]
        g = {"out": np.einsum("tkn,thn->kh", prob, both, optimize=True), "bias": prob.sum(axis=(0, 2))[:, None]}
        up = np.einsum("kh,tkn->thn", p["out"], prob, optimize=True)
        for d, part in (("f", up[:, :h]), ("b", up[:, h:])):
            rec, cand = p[f"rec{d}"], p[f"cand{d}"]
            g_in, g_rec, g_cand = np.zeros((257, 3 * h), np.float32), np.zeros_like(rec), np.zeros_like(cand)
            carry = np.zeros((h, n), np.float32)
            for t, before, gates, gated, new in reversed(kept[d]):
                carry = carry + part[t]
                z, r = gates[:h], gates[h:]
                d_new = carry * (1 - z) * (1 - new * new)
                d_gated = cand.T @ d_new
                d_both = np.concatenate([carry * (before - new) * z * (1 - z), d_gated * before * r * (1 - r)])
                g_cand += d_new @ gated.T
                g_rec += d_both @ before.T
                d_x = np.concatenate([d_both, d_new]).T
                code = codes[:, t]
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                g_in[code[order][first]] += np.add.reduceat(d_x[order], first, axis=0)
                carry = carry * z + d_gated * r + rec.T @ d_both
            g |= {f"in{d}": g_in.T, f"rec{d}": g_rec, f"cand{d}": g_cand}
        return loss, g

    def fit(self, codes: np.ndarray, wanted: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss, steps = 0, 0.0, epochs * -(-len(codes) // batch)
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                loss, g = self.gradients(codes[some], wanted[some])
                size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k in self.p:
                    x = g[k] * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
                    m[k] += np.float32(0.1) * (x - m[k])
                    v[k] += np.float32(0.01) * (x * x - v[k])
                    self.p[k] -= (np.float32(now) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + np.float32(1e-6))).astype(np.float32)
                self.hold()
        return loss

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best label and its mean probability for each text (none empty)."""
        codes, of = segments(texts)
        sums = np.zeros((len(self.labels), len(texts)))
        for i in range(0, len(codes), WIDE):
            part = codes[i : i + WIDE]
            each = (self.position_probabilities(part) * (part.T != PAD)).sum(axis=1)
            for k in range(len(self.labels)):
                sums[k] += np.bincount(of[i : i + WIDE], weights=each[k], minlength=len(texts))
        means = sums / np.maximum(sums.sum(axis=0), 1e-9)
        best = means.argmax(axis=0)
        return best, np.clip(means[best, np.arange(len(texts))], 0, 1)


def training_pieces(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """lang and passages of the sample: at most DOCS * PIECES rows of SEGMENT characters for each language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    md5 = F.md5(F.col(doc_id).cast("string").cast("binary"))
    named = rows.select(F.col(lang).alias("lang"), md5.alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    # a language's documents up to a key that leaves a few more than DOCS: no language is sorted in one task
    n = cut(named.groupBy("lang").agg(F.count("*").alias("n")))
    named = with_groups(named, n, "lang")
    chosen = named.where(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.col("n") <= (DOCS + 6 * DOCS**0.5) * 2.0**32)
    start = lambda i: 1 + F.pmod(F.crc32(F.concat("key", i.cast("string")).cast("binary")), F.greatest(F.length("text") - SEGMENT, F.lit(1)))
    pieces = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substring(F.col("text"), start(i).cast("int"), F.lit(SEGMENT)))
    # equal keys are rows with one doc_id: one of them is enough
    chosen = chosen.groupBy("lang", "key").agg(F.min(pieces).alias("pieces"))
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= DOCS).drop("rank")


def train(docs: DataFrame, **columns: str) -> Network | None:
    """A network fitted on the driver from the bounded sample; None if there is nothing to learn from."""
    rows = sorted((r.lang, r.key, r.pieces) for r in training_pieces(docs, **columns).collect())
    labels = sorted({r[0] for r in rows})
    texts = [(p.encode()[:SEGMENT], labels.index(lang)) for lang, _, pieces in rows for p in pieces if p]
    if not texts:
        return None
    network = Network(labels)
    codes, of = segments([t for t, _ in texts])
    network.fit(codes, np.array([k for _, k in texts])[of])
    return network


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from talkspark.llm.bpe import slices, with_column

        for batch in batches:
            for start, n in slices(batch.column(text), SLICE):
                part = batch.slice(start, n)
                langs, scores = ["und"] * n, [0.0] * n
                texts = part.column(text).to_pylist()
                rows = [k for k, t in enumerate(texts) if t and network and LETTER.search(t)]
                if rows:
                    best, score = network.documents([texts[k].encode() for k in rows])
                    for k, b, s in zip(rows, best.tolist(), score.tolist(), strict=True):
                        langs[k], scores[k] = network.labels[b], s
                yield with_column(with_column(part, "lang_pred", pa.array(langs, pa.string())), "score", pa.array(scores, pa.float64()))

    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
