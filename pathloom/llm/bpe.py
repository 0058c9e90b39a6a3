"""BPE encoding with a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pathloom.llm import vocab
from pathloom.llm.frames import check_free, col
from pathloom.llm.textbatch import Texts, chunks, every_second, hashes, pretokens, spread, tidy

WIDE = 1024  # leaves from which a word has a tree of its own
VAST = 1 << 15  # symbols from which the merges of one rank are made together
CELLS = 1 << 19  # tree nodes at work at once


def _merge_tree(v: vocab.Vocab, symbols: np.ndarray, leaves: int) -> np.ndarray:
    """Merge each row of `symbols` (-1 behind the end of a word); the result has -1 at merged-away places.

    Row by row there is a segment tree: leaf i holds the rank of the pair that begins at i, times `leaves`, plus i, so that
    the root is the leftmost of the lowest-rank pairs. A merge changes three leaves and the nodes above them.
    """
    rows, none = len(symbols), vocab.NONE * leaves
    symbols = np.ascontiguousarray(symbols)
    place = np.arange(leaves)
    after = np.where(np.concatenate([symbols[:, 1:], np.full((rows, 1), -1)], 1) >= 0, place + 1, -1)
    before = np.broadcast_to(place - 1, (rows, leaves)).copy()
    tree = np.full((rows, 2 * leaves), none)
    r, c = np.nonzero(after >= 0)
    rank = v.pair_ranks(symbols[r, c], symbols[r, c + 1])
    tree[r, leaves + c] = np.where(rank < vocab.NONE, rank * leaves + c, none)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    flat, sym, nxt, prv = tree.reshape(-1), symbols.reshape(-1), after.reshape(-1), before.reshape(-1)
    live = np.flatnonzero(tree[:, 1] < none)
    while live.size:
        root = flat[live * (2 * leaves) + 1]
        at = root % leaves
        base = live * leaves
        gone = nxt[base + at]
        behind = nxt[base + gone]
        sym[base + at] = root // leaves
        sym[base + gone] = -1
        nxt[base + at] = behind
        has = behind >= 0
        prv[(base + behind)[has]] = at[has]
        ahead = prv[base + at]
        for side, ok in ((gone, None), (at, has), (ahead, ahead >= 0)):
            if side is gone:
                rows_, leaf, value = live, gone, np.full(live.size, none)
            elif side is at:
                value = np.full(live.size, none)
                r2 = v.pair_ranks(sym[(base + at)[ok]], sym[(base + behind)[ok]])
                value[ok] = np.where(r2 < vocab.NONE, r2 * leaves + at[ok], none)
                rows_, leaf = live, at
            else:
                rows_, leaf = live[ok], ahead[ok]
                r2 = v.pair_ranks(sym[base[ok] + leaf], sym[(base + at)[ok]])
                value = np.where(r2 < vocab.NONE, r2 * leaves + leaf, none)
            _put(flat, rows_ * (2 * leaves), leaf + leaves, value)
        live = live[flat[live * (2 * leaves) + 1] < none]
    return symbols


def _put(flat: np.ndarray, base: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
    """Set one leaf in each tree and bring the nodes above it up to date."""
    flat[base + node] = value
    if not node.size:
        return
    for _ in range(int(node[0]).bit_length() - 1):
        value = np.minimum(value, flat[base + (node ^ 1)])
        node = node >> 1
        flat[base + node] = value


def merge_one(v: vocab.Vocab, symbols: list[int]) -> list[int]:
    """The same for one long word, with plain integers."""
    n = len(symbols)
    leaves = 1 << max(1, (n - 1).bit_length())
    none = int(vocab.NONE) * leaves
    tree = [none] * (2 * leaves)
    ranks = v.pair_ranks(np.array(symbols[:-1]), np.array(symbols[1:])).tolist() if n > 1 else []
    for i, rank in enumerate(ranks):
        if rank < vocab.NONE:
            tree[leaves + i] = rank * leaves + i
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    nxt, prv, known = [*range(1, n), -1], list(range(-1, n - 1)), {}

    def put(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    def key(a: int, b: int) -> int:
        pair = (symbols[a], symbols[b])
        if pair not in known:
            known[pair] = int(v.pair_ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
        return known[pair] * leaves + a if known[pair] < vocab.NONE else none

    symbols = list(symbols)
    while tree[1] < none:
        rank, at = divmod(tree[1], leaves)
        gone = nxt[at]
        behind = nxt[gone]
        symbols[at], symbols[gone], nxt[at] = rank, -1, behind
        put(gone, none)
        if behind >= 0:
            prv[behind] = at
            put(at, key(at, behind))
        else:
            put(at, none)
        if prv[at] >= 0:
            put(prv[at], key(prv[at], at))
    return [s for s in symbols if s >= 0]


def merge_vast(v: vocab.Vocab, symbols: np.ndarray) -> np.ndarray:
    """The same for one word of any length, all merges of the root's rank at a time.

    Leaves hold ranks alone, as their order tells which is leftmost. A merge makes no pair of a lower rank, so the root would
    yield those of one rank one after another, from the left; they are found by going down from it, and the nodes above all
    changed leaves are brought up to date level by level.
    """
    n = len(symbols)
    leaves = 1 << max(1, (n - 1).bit_length())
    symbols, tree = symbols.astype(np.int64), np.full(2 * leaves, vocab.NONE)
    tree[leaves : leaves + n - 1] = v.pair_ranks(symbols[:-1], symbols[1:])
    level = leaves
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
    while tree[1] < vocab.NONE:
        rank, node = tree[1], np.ones(1, np.int64)
        while node[0] < leaves:
            node = (2 * node[:, None] + np.arange(2)).ravel()
            node = node[tree[node] == rank]
        at = every_second(node - leaves, after)
        gone = after[at]
        behind = after[gone]
        symbols[at], symbols[gone], after[at] = rank, -1, behind
        before[behind[behind >= 0]] = at[behind >= 0]
        ahead = before[at]
        node = np.unique(np.concatenate([gone, at, ahead[ahead >= 0]]))
        pair = np.flatnonzero((symbols[node] >= 0) & (after[node] >= 0))
        tree[leaves + node] = vocab.NONE
        tree[leaves + node[pair]] = v.pair_ranks(symbols[node[pair]], symbols[after[node[pair]]])
        node = node + leaves
        while node[0] > 1:
            node = node >> 1
            node = node[np.concatenate([[True], node[1:] != node[:-1]])]
            tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
    return symbols[symbols >= 0]


def merge_words(v: vocab.Vocab, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each word, one word after another, and how many each has."""
    counts = np.ones(len(starts), np.int64)
    pieces: list[tuple[np.ndarray, np.ndarray]] = []  # words, their ids in order
    single = np.flatnonzero(sizes == 1)
    if single.size:
        pieces.append((single, v.byte_id[data[starts[single]]]))
    leaves = 2
    top = int(sizes.max(initial=0))
    while leaves // 2 < top:
        these = np.flatnonzero((sizes <= leaves) & (sizes > max(1, leaves // 2)))
        if leaves > WIDE:
            for w in these:
                symbols = v.byte_id[data[starts[w] : starts[w] + sizes[w]]]
                ids = merge_vast(v, symbols) if len(symbols) >= VAST else np.array(merge_one(v, symbols.tolist()), np.int64)
                counts[w] = len(ids)
                pieces.append((np.array([w]), ids))
        else:
            step = max(1, CELLS // (2 * leaves))
            for low in range(0, these.size, step):
                part = these[low : low + step]
                grid = np.full((part.size, leaves), np.int64(-1))
                at = starts[part][:, None] + np.arange(leaves)
                inside = np.arange(leaves) < sizes[part][:, None]
                grid[inside] = v.byte_id[data[at[inside]]]
                grid = _merge_tree(v, grid, leaves)
                counts[part] = (grid >= 0).sum(1)
                pieces.append((part, grid[grid >= 0]))
        leaves *= 2
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for these, ids in pieces:
        out[spread(place[these], counts[these])] = ids
    return out, counts


def encode_texts(v: vocab.Vocab, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents and the offsets of each; equal pre-tokens of the chunk are merged once."""
    starts, first = pretokens(texts)
    ends, starts = starts[1:], starts[:-1]
    if not starts.size:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    _, one, code = np.unique(hashes(texts.data, starts, ends), return_index=True, return_inverse=True)
    ids, n = merge_words(v, texts.data, starts[one], (ends - starts)[one])
    place = np.cumsum(n) - n
    total = np.concatenate([[0], np.cumsum(n[code])])
    return ids[spread(place[code], n[code])], total[first]


def decode_ids(v: vocab.Vocab, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents and the offsets of each."""
    ends = np.concatenate([[0], np.cumsum(v.lengths[ids])])
    return v.decode(ids), ends[offsets]


def _list(ids: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=None if valid.all() else pa.array(~valid))


def bpe_encode(docs: DataFrame, vocab_path: str = vocab.DEFAULT_PATH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, kept columns, token_ids, n_tokens, decodes_back) for each row of `docs`.

    The whole text is encoded. decodes_back tells whether decoding the ids gives the text byte by byte; so it also proves
    that no two pre-tokens of a chunk were taken for equal by their 64-bit hash. A null text has null in all three, an
    empty one no ids, 0 and true. Repeated rows, repeated or null ids stay as they are; an empty table gives no row; columns
    not named in `keep` are not read. ValueError if `keep` or the id has the name of a column of the result.
    """
    check_free([id_col, *keep], ["token_ids", "n_tokens", "decodes_back"])
    cols = [id_col, *keep]
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(vocab_path)
        for batch in batches:
            for texts in chunks(batch.column(len(cols))):
                ids, offsets = encode_texts(v, texts)
                back, at = decode_ids(v, ids, offsets)
                same = np.diff(at) == np.diff(texts.offsets)
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != texts.data)])
                    same = wrong[texts.offsets[1:]] == wrong[texts.offsets[:-1]]
                else:
                    same = np.array([bytes(back[at[i] : at[i + 1]]) == texts.document(i) for i in range(len(texts))])
                null = ~texts.valid
                kept = [batch.column(i).slice(texts.first_row, len(texts)) for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, _list(ids, offsets, texts.valid), pa.array(np.diff(offsets), mask=null), pa.array(same, mask=null)],
                    [*(f"c{i}" for i in range(len(cols))), "token_ids", "n_tokens", "decodes_back"],
                )

    picked = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(cols)), col(text_col).alias("text"))
    out = picked.mapInArrow(tidy(run), f"{schema}, token_ids array<int>, n_tokens bigint, decodes_back boolean")
    return out.select(*(col(f"c{i}").alias(c) for i, c in enumerate(cols)), "token_ids", "n_tokens", "decodes_back")


def bpe_decode(encoded: DataFrame, vocab_path: str = vocab.DEFAULT_PATH, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row (id, text) for each row of `encoded`.

    Null ids give a null text, no ids an empty one, bytes that are no UTF-8 a replacement sign. Repeated rows and repeated or
    null ids stay as they are; an empty table gives no row; other columns, whatever their names, are not read. ValueError in
    the task for an id that the vocabulary does not have, a null among the ids included.
    """
    if id_col.lower() == "text":
        raise ValueError("the id column cannot be called text, as the result has a column of that name")
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(vocab_path)
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten()
            ids = pc.fill_null(flat, -1).to_numpy()
            if ids.size and not 0 <= ids.min() <= ids.max() < v.size:
                raise ValueError("an id is not in the vocabulary")
            raw, at = decode_ids(v, ids, np.concatenate([[0], np.cumsum(sizes)]))
            null = lists.is_null().to_numpy(zero_copy_only=False)
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes())])
            try:
                texts = texts.cast(pa.large_string())
            except pa.ArrowInvalid:
                texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), texts).cast(pa.string())], ["id", "text"])

    out = encoded.select(col(id_col).alias("id"), col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(run), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
