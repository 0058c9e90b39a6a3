"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pathloom.llm import vocab
from pathloom.llm.frames import col, map_texts
from pathloom.llm.textbatch import Texts, chunks, every_second, hashes, pretokens, spread, tidy

VAST = 1 << 15  # symbols from which a sequence is merged alone


def merge_ranks(v: vocab.Vocab, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many symbols survive in each sequence; `symbols` holds the sequences one after another, none empty.

    In each round every sequence merges all occurrences of its own lowest-rank pair, taken from the left without overlap.
    Sequences without a mergeable pair leave the arrays, so a round costs what is still at work.
    """
    left = sizes.astype(np.int64).copy()
    owner = np.arange(len(sizes))
    size = left.copy()
    symbols = symbols.astype(np.int64)
    ranks = _ranks(v, symbols, size)
    while size.size:
        start = np.cumsum(size) - size
        low = np.minimum.reduceat(ranks, start)
        live = low < vocab.NONE
        if not live.all():
            left[owner[~live]] = size[~live]
            keep = np.repeat(live, size)
            symbols, ranks = symbols[keep], ranks[keep]
            owner, size, low = owner[live], size[live], low[live]
            if not size.size:
                break
        at = every_second(np.flatnonzero(ranks == np.repeat(low, size)), np.arange(1, len(ranks) + 1))
        symbols[at] = ranks[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        seq = np.repeat(np.arange(size.size), size)
        size = size - np.bincount(seq[at], minlength=size.size)
        moved = np.cumsum(keep) - 1
        at = moved[at]
        symbols, ranks, seq = symbols[keep], ranks[keep], seq[keep]
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        ranks[touched] = vocab.NONE
        both = touched[touched + 1 < len(symbols)]
        both = both[seq[both] == seq[both + 1]]
        ranks[both] = v.pair_ranks(symbols[both], symbols[both + 1])
    return left


def merge_vast(v: vocab.Vocab, symbols: np.ndarray) -> int:
    """The same for one very long sequence: neighbours are linked and places noted by their rank, so that a round costs what it
    merges, not the length of the sequence."""
    symbols, n = symbols.astype(np.int64), len(symbols)
    left = n
    after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
    ranks = _ranks(v, symbols, np.array([n]))
    noted: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(places: np.ndarray) -> None:
        places = places[ranks[places] < vocab.NONE]
        order = np.argsort(ranks[places], kind="stable")
        places, of = places[order], ranks[places[order]]
        cut = np.flatnonzero(of[1:] != of[:-1]) + 1
        for rank, part in zip(of[np.concatenate([[0], cut])].tolist() if of.size else [], np.split(places, cut)):
            if rank not in noted:
                noted[rank] = []
                heapq.heappush(queue, rank)
            noted[rank].append(part)

    note(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        at = np.unique(np.concatenate(noted.pop(rank)))
        at = every_second(at[ranks[at] == rank], after)
        if not at.size:
            continue
        gone = after[at]
        behind = after[gone]
        symbols[at], after[at], ranks[gone], ranks[at] = rank, behind, vocab.NONE, vocab.NONE
        before[behind[behind >= 0]] = at[behind >= 0]
        left -= at.size
        ahead = before[at]
        touched = np.unique(np.concatenate([at[behind >= 0], ahead[ahead >= 0]]))
        ranks[touched] = v.pair_ranks(symbols[touched], symbols[after[touched]])
        note(touched)
    return left


def _ranks(v: vocab.Vocab, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
    ranks = np.full(len(symbols), vocab.NONE)
    if len(symbols) > 1:
        ranks[:-1] = v.pair_ranks(symbols[:-1], symbols[1:])
    ranks[np.cumsum(size) - 1] = vocab.NONE
    return ranks


def count(v: vocab.Vocab, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of each document; equal pre-tokens of the chunk are merged once."""
    starts, first = pretokens(texts)
    ends, starts = starts[1:], starts[:-1]
    if not starts.size:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    _, one, code = np.unique(hashes(texts.data, starts, ends), return_index=True, return_inverse=True)
    size = ends[one] - starts[one]
    n, vast = np.empty(len(size), np.int64), size >= VAST
    n[~vast] = merge_ranks(v, v.byte_id[texts.data[spread(starts[one[~vast]], size[~vast])]], size[~vast])
    for i in np.flatnonzero(vast):
        n[i] = merge_vast(v, v.byte_id[texts.data[starts[one[i]] : ends[one[i]]]])
    total = np.concatenate([[0], np.cumsum(n[code])])
    return total[first[1:]] - total[first[:-1]], np.diff(first)


def token_counts(docs: DataFrame, vocab_path: str = vocab.DEFAULT_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, n_pretokens) for each row of `docs`, counted over the whole text.

    Rows: every input row gives one, so repeated rows and repeated or null ids stay as they are, and an empty table gives
    none. A null text has null counts, an empty one zero. Other columns of `docs`, whatever their names, are not read.
    Equal pre-tokens are recognised by a 64-bit hash within a chunk of some MB.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(vocab_path)
        for batch in batches:
            for texts in chunks(batch.column(1)):
                tokens, pieces = count(v, texts)
                ids = batch.column(0).slice(texts.first_row, len(texts))
                null = ~texts.valid
                yield pa.RecordBatch.from_arrays([ids, pa.array(tokens, mask=null), pa.array(pieces, mask=null)], ["id", "n_tokens", "n_pretokens"])

    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, n_pretokens bigint")
    return out.withColumnRenamed("id", id_col)


def counted_by(docs: DataFrame, vocab_path: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row (k0, k1, ..., t) for each row of `docs`: some of its columns and how many tokens its text has, 0 for a null text."""

    def start():
        v = vocab.load(vocab_path)
        return lambda texts: [count(v, texts)[0]]

    made = T.StructType([T.StructField("t", T.LongType())])
    picked = docs.select(*(col(k).alias(f"k{i}") for i, k in enumerate(keys)), col(text_col).alias("text"))
    return map_texts(picked, [f"k{i}" for i in range(len(keys))], "text", start, made)
