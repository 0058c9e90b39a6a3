"""Token ids as binary shards: concatenated ids, document boundaries in Elias-Fano code."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pathloom.llm import vocab
from pathloom.llm.bpe import encode_texts
from pathloom.llm.frames import col
from pathloom.llm.textbatch import chunks, tidy

SAMPLE = 256  # every so many ones of the upper part have their place written down


class EliasFano:
    """A non-decreasing sequence of integers, read at any place without unpacking it.

    Each value is split: its `low` bits stand packed one after another; the rest is a bit vector in which the i-th one is
    at (value >> low) + i. With low = log2(last / n) this takes about 2 + log2(last / n) bits a value. get(i) finds the i-th
    one from a directory with a 32-bit place for every 256th, by counting bits of the words between.
    """

    HEAD = struct.Struct("<QQBI")

    def __init__(self, n: int, last: int, low: int, lows: np.ndarray, highs: np.ndarray, places: np.ndarray):
        self.n, self.last, self.low, self.lows, self.highs, self.places = n, last, low, lows, highs, places

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the values must not decrease")
        last = int(values[-1]) if n else 0
        low = max(0, (last // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little")
        ones = ((values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        size = int(ones[-1]) + 1 if n else 0
        if size >= 1 << 32:
            raise ValueError("too many values for one sequence")
        upper = np.zeros(-(-size // 64) * 64, np.uint8)
        upper[ones] = 1
        return cls(n, last, low, lows, np.packbits(upper, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.last, self.low, len(self.highs)) + self.highs.tobytes() + self.places.tobytes() + self.lows.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, last, low, size = cls.HEAD.unpack_from(raw)
        at = cls.HEAD.size
        highs = np.frombuffer(raw, "<u8", size, at)
        places = np.frombuffer(raw, "<u4", -(-n // SAMPLE), at := at + 8 * size)
        return cls(n, last, low, np.frombuffer(raw, np.uint8, -(-n * low // 8), at + 4 * len(places)), highs, places)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Place of the i-th one of the upper part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.places[i // SAMPLE]), i % SAMPLE
        word = start // 64
        bits = int(self.highs[word]) >> start % 64 << start % 64
        while (count := bits.bit_count()) <= left:
            left -= count
            word += 1
            bits = int(self.highs[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def get(self, i: int) -> int:
        high = self.select(i) - i
        start = i * self.low
        first, last = start // 8, -(-(start + self.low) // 8)
        low = int.from_bytes(self.lows[first:last].tobytes(), "little") >> start % 8 & (1 << self.low) - 1
        return high << self.low | low

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.highs).view(np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        low = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64)) if self.low else np.zeros(self.n, np.uint64)
        return (ones.astype(np.uint64) - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low) | low


def read_document(ids: bytes, boundaries: bytes, width: int, i: int) -> np.ndarray:
    """Token ids of the i-th document of a shard."""
    places = EliasFano.from_bytes(boundaries)
    start, end = places.get(i), places.get(i + 1)
    return np.frombuffer(ids, f"<u{width}", end - start, start * width)


def token_shards(docs: DataFrame, vocab_path: str = vocab.DEFAULT_PATH, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (shard, doc_ids, n_tokens, width, ids, boundaries): the documents' token ids, a few hundred thousand a row.

    ids holds the ids of all documents of the shard as little-endian integers of `width` bytes, 2 where the vocabulary
    allows it; boundaries is the Elias-Fano code of where each document begins and the last one ends. Each task fills its
    own shards in the order of its rows, so nothing is shuffled, and a task that runs again makes the same shards; `shard`
    is the task's partition and a running number. A document is never cut: one longer than `shard_tokens` has a shard of
    its own. A null or empty text is a document without tokens; repeated rows and repeated or null ids are kept as they
    are; an empty table gives no row. Other columns of `docs` are not read.
    """

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_tokens", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("boundaries", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(vocab_path)
        width = 2 if v.size <= 1 << 16 else 4
        partition, made = TaskContext.get().partitionId() << 32, 0
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            held = pa.concat_arrays(names)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            arrays = [
                pa.array([partition | made], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array([total], pa.int64()),
                pa.array([width], pa.int32()),
                pa.array([np.concatenate(parts).tobytes()], pa.binary()),
                pa.array([EliasFano.build(ends).to_bytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            for texts in chunks(batch.column(1)):
                ids, at = encode_texts(v, texts)
                start, n = 0, len(texts)
                while start < n:
                    end = int(np.searchsorted(at, at[start] + shard_tokens - total, "right")) - 1  # as many as the shard has room for
                    if end <= start:
                        if names:
                            yield shard()
                            made, total = made + 1, 0
                            names, parts, sizes = [], [], []
                            continue
                        end = start + 1
                    names.append(batch.column(0).slice(texts.first_row + start, end - start))
                    parts.append(ids[at[start] : at[end]].astype(f"<u{width}"))
                    sizes.append(np.diff(at[start : end + 1]))
                    total += int(at[end] - at[start])
                    start = end
        if names:
            yield shard()

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(tidy(run), schema)
