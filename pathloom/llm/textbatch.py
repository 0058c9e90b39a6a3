"""Texts of a batch as numpy arrays: bytes, character classes, pre-token and word boundaries, word hashes.

Everything works on one flat byte buffer with document offsets, so no Python string per word exists.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20  # arrays of some ten bytes for each byte of a chunk are at work at once
LONG_WORD = 256  # bytes; longer words are hashed one by one
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_U = np.uint64


class Texts:
    """A chunk of documents: `data` is their UTF-8, document i is data[offsets[i]:offsets[i + 1]]; a null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, first_row: int = 0):
        self.data, self.offsets, self.valid, self.first_row = data, offsets, valid, first_row

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        raw = [b"" if t is None else t.encode() for t in texts]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(b) for b in raw], out=offsets[1:])
        return cls(np.frombuffer(b"".join(raw), np.uint8), offsets, np.array([t is not None for t in texts], bool))

    def document(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> Texts:
        """The same documents in lower case."""
        if not len(self.data):
            return self
        if self.data.max() < 128:
            upper = (self.data >= 65) & (self.data <= 90)
            return Texts(self.data + (upper * np.uint8(32)), self.offsets, self.valid, self.first_row)
        out = Texts.of([self.document(i).decode("utf-8", "replace").lower() for i in range(len(self))])
        return Texts(out.data, out.offsets, self.valid, self.first_row)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut an Arrow string column into runs of whole documents of about `limit` bytes; one longer document is a run alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    if not valid.all():
        column = column.fill_null("")
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, n)
        low, high = int(offsets[start]), int(offsets[end])
        yield Texts(data[low:high], offsets[start : end + 1] - low, valid[start:end], start)
        start = end


@lru_cache(1)
def _class_table() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[0x1C:0x20] = OTHER  # separators that the vocabularies' pattern does not count as white space
    return table


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte: that of the character it belongs to."""
    table = _class_table()
    out = np.where(data < 128, table[:128][np.minimum(data, 127)], np.uint8(OTHER)).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        b0, b1, b2, b3 = (padded[lead + k].astype(np.int64) for k in range(4))
        two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
        code = np.where(
            two,
            (b0 & 31) << 6 | b1 & 63,
            np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63),
        )
        kind = table[np.minimum(code, 0x10FFFF)]
        size = np.where(two, 2, np.where(three, 3, 4))
        for k in range(4):
            here = size > k
            at = lead[here] + k
            ok = at < len(out)
            out[at[ok]] = kind[here][ok]
    return out


def pretokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pre-tokens, with the end of the buffer appended, and the first pre-token of each document.

    Equal to the pattern of the byte-level vocabularies: contractions, then runs of letters, of numbers or of other
    characters with at most one space before them, then white space, of which the last character before a word stands alone.
    """
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes(data)
    first = np.zeros(n + 4, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    first[n:] = True
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= first[:n]
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], n)
    word = kind[runs] != SPACE
    at = runs[word]
    at = at[(at > 0) & ~first[at]]
    at = at[data[at - 1] == 32]
    begin[at] = False
    begin[at - 1] = True
    gap = ~word & ~first[ends] & (data[ends - 1] != 32)
    last = ends[gap] - 1
    low = runs[gap]
    while (back := (data[last] & 0xC0) == 0x80).any():
        last = last - back
    last = last[last > low]
    begin[last] = True
    quote = np.flatnonzero((data == 39) & begin)
    if quote.size:
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        letters = np.concatenate([kind, np.zeros(4, np.uint8)]) == LETTER
        inside = ~first[quote + 1]
        one = inside & np.isin(padded[quote + 1], np.frombuffer(b"stmd", np.uint8))
        pair = padded[quote + 1].astype(np.int64) << 8 | padded[quote + 2]
        two = inside & ~first[quote + 2] & np.isin(pair, [0x7265, 0x7665, 0x6C6C])
        for hit, width in ((one, 2), (two, 3)):
            a = quote[hit]
            begin[a + 1] = False
            rest = a + width
            begin[rest[(rest < n) & ~first[rest] & letters[rest]]] = True
    starts = np.append(np.flatnonzero(begin), n)
    return starts, np.searchsorted(starts[:-1], offsets)


def words(texts: Texts, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word of each document, where a word is a run of letters and numbers."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    inside = (classes(data) if kind is None else kind) <= NUMBER
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes at a step over all words at once."""
    size = ends - starts
    out = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while live.size:
        lane = lanes[starts[live] + done] & masks[np.minimum(size[live] - done, 8)]
        out[live] = mix(out[live] ^ lane) + _U(0x9E3779B97F4A7C15)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] ^= _U(xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes()))
    return out


def tidy(run: Callable) -> Callable:
    """The function of a task; when it ends, memory that its Python worker holds on to for later goes back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, all runs one after another."""
    total = int(counts.sum())
    shift = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, counts)


def every_second(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of the places `at`, in order, where pairs of one rank begin, those that merge from the left without overlap: of neighbours,
    each being the one `after` the one before, every second."""
    if at.size < 2:
        return at
    run = after[at[:-1]] == at[1:]
    if not run.any():
        return at
    count = np.arange(at.size)
    head = np.concatenate([[True], ~run])
    return at[(count - np.maximum.accumulate(np.where(head, count, 0))) % 2 == 0]
