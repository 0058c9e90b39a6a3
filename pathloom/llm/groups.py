"""Groups of near-equal items: verified links inside the lists of an inverted index, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 24  # longest list whose pairs are all looked at in any case
LONG = 512  # longest list whose pairs are all looked at if pivots do not pay
POOR = 16  # a pivot pays that links at least one in so many of the items it is compared with
PAIRS = 1 << 17  # pairs at work at once
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]
Split = Callable[[np.ndarray], "tuple[np.ndarray, np.ndarray] | None"]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, all runs one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _all_pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in each of some runs, some at a time."""
    first = _spread(start, size)
    behind = np.repeat(start + size, size) - first - 1
    total = np.cumsum(behind)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = behind[at:end]
        yield np.repeat(first[at:end], n), _spread(first[at:end] + 1, n)
        at = end


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (i, j) among n places make up the same groups without a circle; fewer than n.

    Each root that has a lower neighbour hangs on to the least of them, by one link, until no link joins two roots.
    """
    root, open_, kept = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        a, b = root[i[open_]], root[j[open_]]
        apart = a != b
        open_, low, high = open_[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(open_):
            return np.concatenate(kept)
        least, link = np.full(n, n), np.zeros(n, np.int64)
        np.minimum.at(least, high, low)
        hit = least[high] == low
        link[high[hit]] = open_[hit]
        joined = np.flatnonzero(least < n)
        root[joined] = least[joined]
        kept.append(link[joined])
        while (root[root] != root).any():
            root = root[root]


class Links:
    """Links among n places. Close copies have links by the square of their number; whenever more are held than the places
    account for, only a forest of them stays, which joins the same."""

    def __init__(self, n: int):
        self.n, self.held = n, 0
        self.left, self.right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.left.append(i)
        self.right.append(j)
        self.held += len(i)
        if self.held > 2 * self.n + PAIRS:
            i, j = self.thinned()
            self.left, self.right, self.held = [i], [j], len(i)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.left), np.concatenate(self.right)

    def thinned(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = self.all()
        some = forest(i, j, self.n)
        return i[some], j[some]


def links_in_lists(keys: np.ndarray, items: np.ndarray, distance: Test, limit: float, maybe: Test | None = None, split: Split | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links within lists.

    `keys` is sorted; a list is a run of one key. Items of a list that a chain of steps of at most `limit` joins become
    linked, and only such steps are links. Short lists compare every pair. Longer ones go by pivots, a round for all such
    lists at once: all within `limit` of a list's pivot are linked to it; `distance` being a metric, an item at d <= limit from
    the pivot can only be near items between limit and limit + d from it, so all others need no comparison with it. So a large
    group of close copies costs its size, not its square, and nothing is left out. Where few items are near the pivot, the
    rest is compared pair by pair; if it is long and `split` is given, that gets its places and returns the links among
    them, or None if it cannot tell, and then pivots go on. `maybe` is a cheaper test that every pair which counts passes:
    pair by pair, only those that pass it are measured. Where links become many, some that join the same are returned.
    """
    found = Links(len(keys))

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        near = distance(items[i], items[j]) <= limit
        found.add(i[near], j[near])

    def compare_all(places: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        for i, j in _all_pairs(start, size):
            i, j = places[i], places[j]
            if maybe is not None:
                ok = maybe(items[i], items[j])
                i, j = i[ok], j[ok]
            compare(i, j)

    start, size = _runs(keys)
    some = size > 1
    start, size = start[some], size[some]
    places, fresh = _spread(start, size), np.ones(len(size), bool)  # of all lists still at work; fresh: not yet split in vain
    poor = np.zeros(len(size), bool)
    while len(places):
        start = np.cumsum(size) - size
        done = (size <= SMALL) | poor & (size <= LONG)
        compare_all(places, start[done], size[done])
        for k in np.flatnonzero(poor & ~done & fresh) if split is not None else ():
            among = split(places[start[k] : start[k] + size[k]])
            if among is not None:
                found.add(*among)
            done[k], fresh[k] = among is not None, False
        start, size, fresh = start[~done], size[~done], fresh[~done]
        if not len(size):
            break
        which = np.repeat(np.arange(len(size)), size - 1)
        pivot, rest = places[start][which], places[_spread(start + 1, size - 1)]
        d = distance(items[pivot], items[rest])
        near = d <= limit
        found.add(pivot[near], rest[near])
        # linked items stay at work only if something unlinked may be within reach of them
        reach = np.full(len(size), np.inf)
        edge = ~near & (d <= 2 * limit)
        np.minimum.at(reach, which[edge], d[edge] - limit)
        stay = ~near | (d >= reach[which])
        poor = np.bincount(which[near], minlength=len(size)) * POOR < size
        places, size = rest[stay], np.bincount(which[stay], minlength=len(size))
        some = size > 1
        places = places[np.repeat(some, size)]
        size, poor, fresh = size[some], poor[some], fresh[some]
    return found.all()


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, sorted by their first column, cut between lists only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() == keys[-1] and held[-1].column(0)[-1].as_py() == keys[0]:
            held.append(batch)  # a list longer than a batch goes on
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of `edges` (a, b); the root is the least node of what is connected.

    Contraction: each node points to its least neighbour or, being less than all of them, to itself; pointers are followed to
    their end by doubling; edges are renamed to these ends, loops and doubles go. A round leaves at most half of the nodes
    that still have edges, and doubling takes the logarithm of the longest way, so rounds stay few on chains too. Every step
    is written by checkpoint().
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    both = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    named = both.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        ways = edges.select(F.col("a").alias("old"), F.col("b").alias("to")).union(edges.select("b", "a"))
        least = ways.groupBy("old").agg(F.min("to").alias("to")).select("old", F.least("old", "to").alias("new")).checkpoint()
        while True:
            hop = least.select(F.col("old").alias("new"), F.col("new").alias("further"))
            least = least.join(hop, "new").select("old", F.col("further").alias("new"), (F.col("new") != F.col("further")).alias("moved")).checkpoint()
            if least.where("moved").isEmpty():
                break
            least = least.drop("moved")
        least = least.drop("moved")
        named = named.join(least, named["root"] == least["old"], "left").select("node", F.coalesce("new", "root").alias("root")).checkpoint()
        a = least.select(F.col("old").alias("a"), F.col("new").alias("na"))
        b = least.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        edges = edges.join(a, "a").join(b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct().checkpoint()
    return named
