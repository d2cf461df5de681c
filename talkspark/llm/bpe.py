"""Operator 8, BPE encoding and decoding with a public byte-level vocabulary.

Texts are cut into words by the vocabulary's pattern. Each different word is encoded once per dictionary by the
contiguous rank array: the parts of a word and the ranks of its adjacent pairs lie side by side; the lowest
rank is searched, the boundary there is deleted, and the two neighbouring ranks are looked up anew, until no
pair has a rank. Words of one length go through this together, as rows of a matrix: each turn takes one
boundary from every row that still has a rank, so rows stay equally long. Words over SHORT bytes, for which
a scan for each merge would be quadratic, keep their ranks in a heap instead, with the same result.

The vocabulary is a file (path as parameter), read once by each Python worker. Dictionaries are dropped when
they hold DICTIONARY words, which only costs time; texts are worked in slices of about SLICE bytes.

Defined results: a null or empty text gives no ids and the empty text; a special token's string in a text gets
its id, as the library does; ids outside the vocabulary are skipped in decoding, bytes that aren't UTF-8 become
replacement characters; repeated rows are encoded one by one; an empty table gives no rows; other columns pass
through, and an input column named like the output is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.llm.common import tidy

SHORT, DICTIONARY, SLICE = 48, 200_000, 2_000_000
NONE = np.iinfo(np.int32).max
#: The pattern of byte-level BPE, with white space as the Unicode property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, their bytes and the merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters, model = byte_letters(), made["model"]
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = size
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        # open addressing, a quarter full: slot -> pair and its rank
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        for key, rank in self.ranks.items():
            at = int(self._slot(np.array([key]))[0])
            while self.slot_key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slot_key[at], self.slot_rank[at] = key, rank
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.words = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the pair doesn't merge."""
        keys = left * self.size + right
        at, out = self._slot(keys), np.full(len(keys), NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.slot_key[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            if n == 0:
                for r in rows:
                    out[r] = np.zeros(0, dtype=np.int64)
                continue
            if n > SHORT:
                for r in rows:
                    out[r] = self.encode_long(words[r])
                continue
            parts = self.byte_ids[np.frombuffer(b"".join(words[r] for r in rows), dtype=np.uint8).reshape(len(rows), n)]
            ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(rows), n - 1)
            while len(rows):
                if parts.shape[1] == 1:
                    for r, p in zip(rows, parts, strict=True):
                        out[r] = p
                    break
                at = ranks.argmin(axis=1)
                low = ranks[np.arange(len(rows)), at]
                still = low != NONE
                for i in np.flatnonzero(~still):
                    out[rows[i]] = parts[i]
                rows, parts, ranks, at, low = rows[still], parts[still], ranks[still], at[still], low[still]
                if not len(rows):
                    break
                own, width = np.arange(len(rows)), parts.shape[1]
                parts[own, at] = self.made[low]
                # delete the boundary after `at`: what stands to the right moves one place
                keep = np.arange(width - 1)[None, :]
                parts = np.take_along_axis(parts, keep + (keep > at[:, None]), axis=1)
                keep = np.arange(width - 2)[None, :]
                ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.rank(parts[left, at[left] - 1], parts[left, at[left]])
                right = np.flatnonzero(at < width - 2)
                ranks[right, at[right]] = self.rank(parts[right, at[right]], parts[right, at[right] + 1])
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word: a heap of (rank, place) over a linked list of parts."""
        parts = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, size, ranks = len(parts), self.size, self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(parts[x] * size + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], dtype=np.int64)

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if not any(s in text for s in self.special):
            return self.words.findall(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.words.findall(part)
        return out


class Encoder:
    """A dictionary of words met so far, with their ids in one flat array."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids after each other, and the number of ids of each text."""
        if len(self.places) > DICTIONARY:
            self.reset()
        known = len(self.places)
        place, at, counts = self.places.__getitem__, [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                own = self.v.pieces(text)
                counts[k] = len(own)
                at.extend(map(place, own))
        if len(self.places) > known:
            self.learn(list(islice(self.places, known, None)))
        index = np.array(at, dtype=np.int64)
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.starts[index] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(upto)

    def learn(self, words: list[str]) -> None:
        special = self.v.special
        new = self.v.encode_words([b"" if w in special else w.encode() for w in words])
        new = [np.array([special[w]]) if w in special else x for w, x in zip(words, new, strict=True)]
        lengths = np.array([len(x) for x in new], dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.concatenate(new).astype(np.int32)])


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of a string column of about so many bytes, a row at least."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, end - start
        start = end


def id_slices(column: pa.Array, size: int = SLICE // 4) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of a column of lists with about so many elements, a row at least."""
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))])
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1)
        yield start, end - start
        start = end


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a last column; one of the same name goes."""
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], [*(batch.schema.names[i] for i in keep), name])


def ids_of(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    flat, counts = encoder.encode(texts.to_pylist())
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def texts_of(v: Vocabulary, column: pa.Array) -> pa.Array:
    """The text of each list of ids; null gives an empty one, ids that aren't known nothing."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    known = (values >= 0) & (values < v.size)
    values = np.where(known, values, 0)
    lengths = np.where(known, v.lengths[values], 0)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    data = v.flat[np.repeat(v.starts[values] - ends + lengths, lengths) + np.arange(total)].tobytes()
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of ids for each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary))
        for batch in batches:
            for start, n in slices(batch.column(text)):
                part = batch.slice(start, n)
                yield with_column(part, ids, ids_of(encoder, part.column(text)))

    fields = [f for f in docs.schema.fields if f.name != ids]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), True))]))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of an array of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        for batch in batches:
            for start, n in id_slices(batch.column(ids)):
                part = batch.slice(start, n)
                yield with_column(part, text, texts_of(v, part.column(ids)))

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(text, T.StringType(), True)]))


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs without the text, with its ids and what these decode to: one worker and one vocabulary for both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        encoder = Encoder(v)
        for batch in batches:
            for start, n in slices(batch.column(text)):
                part = batch.slice(start, n)
                found = ids_of(encoder, part.column(text))
                part = with_column(part.select(names), ids, found)
                for at, k in id_slices(found):
                    yield with_column(part.slice(at, k), decoded, texts_of(v, found.slice(at, k)))

    fields = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    names = [f.name for f in fields]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), True)), T.StructField(decoded, T.StringType(), True)]))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = round_trip(docs, vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
