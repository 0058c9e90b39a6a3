"""Embedding near-dedup: pivot-permutation index with shared-pivot counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.frames import check_free, col, ready_for_checkpoint
from pathloom.llm.groups import components, links_in_lists, whole_lists
from pathloom.llm.textbatch import tidy


@dataclass(frozen=True)
class Params:
    """cosine: least similarity of a pair. near: how many nearest pivots describe a vector at least, widest: up to how many
    before there are fewer pivots instead. shared: how many two vectors of a candidate pair have in common at least, 1 or 2.
    least_pivots, per_root: see `pivot_count`. recall, probes: see `fitted`."""

    cosine: float = 0.9
    near: int = 7
    widest: int = 32
    shared: int = 2
    least_pivots: int = 128
    per_root: float = 2.0
    recall: float = 0.95
    probes: int = 512
    seed: int = 5


def pivot_count(n: int, p: Params) -> int:
    """Pivots for n vectors: they grow with the root of n, so that lists for two pivots keep their length."""
    return min(n, max(p.least_pivots, math.ceil(p.per_root * math.sqrt(n))))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def probe_pairs(x: np.ndarray, cosine: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and partners at exactly `cosine` from them: one set parted in directions in which the data spread, one in any."""
    rng = np.random.default_rng(seed)
    out = []
    for away in (x[rng.permutation(len(x))] - x.mean(0), rng.normal(size=x.shape)):
        away = _unit(away - np.einsum("ij,ij->i", away, x)[:, None] * x)
        out.append((x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * away))
    return out


def fitted(picked: np.ndarray, n: int, p: Params) -> tuple[np.ndarray, np.ndarray, int]:
    """Centre of the vectors, pivots (centred unit vectors) and how many nearest ones describe each of n vectors.

    Vectors that lie close together would all have the same few pivots in other orders, so ranks are of what is left without
    the centre. More pivots and closer vectors need more of the nearest ones: as many are taken as let at least `recall` of
    pairs at exactly the limit become candidates, tried on vectors of the table itself that are no pivots. Where `widest`
    do not suffice, pivots are halved, down to where every pair is a candidate. picked: a random sample, the pivots first.
    """
    count = min(pivot_count(n, p), len(picked))
    centre = picked.mean(0, dtype=np.float64)
    probes = picked[count : count + p.probes].astype(np.float64)
    pairs = probe_pairs(probes if len(probes) >= 64 else picked[: p.probes].astype(np.float64), p.cosine, p.seed)
    while True:
        pivots = _unit(picked[:count] - centre)
        ranked = [(permutations(x - centre, pivots, p.widest), permutations(y - centre, pivots, p.widest)) for x, y in pairs]
        for near in range(min(p.near, count), min(p.widest, count) + 1):
            shared = min(p.shared, near)
            if all((shared_pivots(a[:, :near], b[:, :near]) >= shared).mean() >= p.recall for a, b in ranked):
                return centre.astype(np.float32), pivots.astype(np.float32), near
        count = max(count // 2, min(p.widest, count))


def shared_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots the two descriptions in each row have in common."""
    return (a[:, :, None] == b[:, None, :]).sum((1, 2))


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that both sorted descriptions in each row have."""
    both = (a[:, :, None] == b[:, None, :]).any(2)
    return a[np.arange(len(a)), both.argmax(1)] if len(a) else np.zeros(0, np.int64)


def permutations(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first; ties by the pivot's number."""
    out = []
    for s in range(0, len(x), 2000):
        sim = x[s : s + 2000] @ pivots.T
        k = min(near, sim.shape[1])
        top = np.sort(np.argpartition(-sim, k - 1, axis=1)[:, :k], axis=1)
        rank = np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(top, rank, 1))
    return np.concatenate(out) if out else np.zeros((0, near), np.int64)


def lists_of(perm: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots in order of their numbers, and how many of them name the lists that a vector is in.

    Two vectors with at least `shared` pivots in common have one among the first len - shared + 1 of both.
    """
    return np.sort(perm, axis=1), max(1, perm.shape[1] - shared + 1)


def cuts(lists: tuple[np.ndarray, np.ndarray], pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table of lists, each as often as it has pivots behind that of its list, sorted by list and such a pivot.

    lists: number of the list of each row and its pivot; the rows that share a value of the returned key have both pivots.
    """
    number, own = lists
    row, slot = np.nonzero(pivots > own[:, None])
    key = number[row] << 32 | pivots[row, slot]
    order = np.argsort(key, kind="stable")
    return key[order], row[order]


def alike(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether unit vectors may be as similar, in single precision with a margin for its errors."""
    return np.einsum("ij,ij->i", a, b) >= cosine - 1e-4


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle of unit vectors, a metric."""
    return np.arccos(np.clip(np.einsum("ij,ij->i", a, b, dtype=np.float64), -1, 1))


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary())
    return np.frombuffer(column.buffers()[2], np.float32)[column.offset * dim : (column.offset + len(column)) * dim].reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, dim, v): unit vectors as bytes of float32; null where a vector is null, empty, zero or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4000):
                ids, lists = batch.column(0).slice(s, 4000), batch.column(1).slice(s, 4000)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy()
                start = np.cumsum(size) - size
                parts, order = [], []
                good = np.zeros(len(size), bool)
                for dim in np.unique(size[size > 0]):
                    rows = np.flatnonzero(size == dim)
                    x = flat[start[rows][:, None] + np.arange(dim)]
                    with np.errstate(over="ignore", invalid="ignore"):
                        norm = np.sqrt((x * x).sum(1))
                    ok = np.isfinite(norm) & (norm > 0)
                    good[rows[ok]] = True
                    order.append(rows[ok])
                    parts.append(_binary((x[ok] / norm[ok][:, None]).astype(np.float32)))
                order.append(np.flatnonzero(~good))
                parts.append(pa.nulls(int((~good).sum()), pa.binary()))
                place = np.argsort(np.concatenate(order), kind="stable")
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.where(good, size, 0).astype(np.int32)), pa.concat_arrays(parts).take(pa.array(place))], ["id", "dim", "v"])

    kind = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType())])
    return vectors.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("vec")).mapInArrow(tidy(run), kind)


def sample(distinct: DataFrame, n: int, k: int, seed: int) -> np.ndarray:
    """About k of n vectors at random, chosen by a hash; few more than k go to the driver, whatever the number of partitions."""
    h = F.xxhash64("v", F.lit(seed))
    share = min(1.0, (k + 4 * math.sqrt(k) + 8) / max(n, 1))
    rows = distinct.select("v", h.alias("h"))
    if share < 1:
        rows = rows.where(F.pmod(h, F.lit(1 << 53)) < F.lit(int(share * (1 << 53))))
    return np.stack([np.frombuffer(v, np.float32) for _, v in sorted((r["h"], bytes(r["v"])) for r in rows.collect())][:k])


def links(distinct: DataFrame, n: int, dim: int, p: Params) -> DataFrame:
    """Links (a, b) between the numbers of n distinct unit vectors (no, v): those that have pivots in common and are similar enough.

    The index is by pivot; a row travels to each list. Where a list comes together it is cut up by a second pivot, so that
    only vectors with two pivots in common are compared. A pair is told by the list of the first pivot that both have.
    """
    centre, chosen, near = fitted(sample(distinct, n, pivot_count(n, p) + p.probes, p.seed), n, p)
    pivots = distinct.sparkSession.sparkContext.broadcast(chosen)  # sqrt(n) vectors
    limit = math.acos(p.cosine)
    shared = min(p.shared, near)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, no = _rows(batch.column(0), dim), batch.column(1).to_numpy()
            for s in range(0, len(x), 1000):
                part = x[s : s + 1000]
                perm, first = lists_of(permutations(part - centre, pivots.value, near), shared)
                both = np.concatenate([part, perm.astype(np.int32).view(np.float32)], 1)  # a vector and its pivots travel together
                yield pa.RecordBatch.from_arrays([pa.array(perm[:, :first].ravel().astype(np.int64)), _binary(np.repeat(both, first, 0)), pa.array(np.repeat(no[s : s + 1000], first))], ["key", "v", "no"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            own, both, no = table.column(0).to_numpy(), _rows(table.column(1), dim + near), table.column(2).to_numpy()
            x, perm = both[:, :dim], np.ascontiguousarray(both[:, dim:]).view(np.int32).astype(np.int64)
            number = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]])) if len(own) else own
            if shared == 1:
                key, row = number, np.arange(len(own))
            else:
                key, row = cuts((number, own), perm)
            i, j = links_in_lists(key, row, lambda a, b: angle(x[a], x[b]), limit, maybe=lambda a, b: alike(x[a], x[b], p.cosine))
            pair = np.unique(np.minimum(row[i], row[j]) * len(own) + np.maximum(row[i], row[j]))
            i, j = np.divmod(pair, max(len(own), 1))
            first = first_shared(perm[i], perm[j]) == own[i]
            yield pa.RecordBatch.from_arrays([pa.array(no[i[first]]), pa.array(no[j[first]])], ["a", "b"])

    posted = distinct.select("v", "no").mapInArrow(tidy(post), "key bigint, v binary, no bigint")
    return posted.repartition("key").sortWithinPartitions("key", "no").mapInArrow(tidy(join), "a bigint, b bigint")


def near_groups(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "group_id") -> DataFrame:
    """One row (id, group) for each row of `vectors`; the group is the least id that links of at least `cosine` connect.

    Every vector is indexed and looks through its lists. Vectors of one direction are one entry of the index, known by 128
    bits of hash. Only vectors of one length are compared. A null, empty, zero or not finite vector is alone in its group.
    Repeated rows share a group; null ids count as greatest, so a group of rows without ids has a null name; an empty table
    gives no row. Other columns are not read. ValueError if `group_col` is the id's name.
    """
    check_free([id_col], [group_col])
    spark = vectors.sparkSession
    ready_for_checkpoint(spark)
    units = unit_vectors(vectors, id_col, vec_col).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2")).checkpoint()
    least = F.min(F.struct(F.col("id").isNull().alias("missing"), "id")).alias("w")
    once = units.where("v is not null").groupBy("h1", "h2").agg(F.min("dim").alias("dim"), F.min("v").alias("v"), least)
    distinct = once.select("*", F.monotonically_increasing_id().alias("no")).checkpoint()
    edges = None
    for dim, n in sorted(map(tuple, distinct.groupBy("dim").count().collect())):
        found = links(distinct.where(F.col("dim") == dim), n, dim, p)
        edges = found if edges is None else edges.union(found)
    if edges is None:
        edges = spark.createDataFrame([], "a bigint, b bigint")
    named = components(edges)
    rooted = distinct.select("h1", "h2", "no", "w").join(named, distinct["no"] == named["node"], "left").select("h1", "h2", "w", F.coalesce("root", "no").alias("root"))
    names = rooted.groupBy("root").agg(F.min("w").alias("least")).join(rooted.select("root", F.col("h1").alias("g1"), F.col("h2").alias("g2")), "root").select("g1", "g2", F.col("least.id").alias("least"))
    rows = units.select("id", F.col("v").isNull().alias("alone"), "h1", "h2")
    out = rows.join(names, ~F.col("alone") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return out.select("id", F.when(F.col("alone"), F.col("id")).otherwise(F.col("least")).alias("least")).toDF(id_col, group_col)
