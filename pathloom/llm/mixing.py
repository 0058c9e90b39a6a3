"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.frames import check_free, col, free_name, ready_for_checkpoint
from pathloom.llm.token_counts import counted_by

TOKEN = "[^ \\t\\n\\r]+"
DENSE = 400  # categories up to which the Hessian is held densely
MANY = 1_000_000  # categories that are broadcast at most


def token_count(text: Column) -> Column:
    """Tokens of a text as the mixture counts them: runs without white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _solve(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x with H x = right for a sparse symmetric H >= 0, of least squares where H is singular; by conjugate gradients if H is large."""
    n = len(right)
    if n <= DENSE:
        h = np.zeros((n, n))
        np.add.at(h, (rows, columns), values)
        return np.linalg.lstsq(h, right, rcond=1e-12)[0]
    scale = np.bincount(rows[rows == columns], values[rows == columns], n)
    scale = 1 / np.maximum(scale, 1e-300)
    x, r = np.zeros(n), right.copy()
    z = scale * r
    d, old = z.copy(), float(r @ z)
    for _ in range(1000):
        if old <= 1e-24 * max(1.0, float(right @ (scale * right))):
            break
        hd = np.bincount(rows, values * d[columns], n)
        curve = float(d @ hd)
        if curve <= 0:
            break
        x, r = x + old / curve * d, r - old / curve * hd
        z = scale * r
        new = float(r @ z)
        d, old = z + new / old * d, new
    return x


def balance(cells: DataFrame, margins: list[str], targets: list[Mapping[str, float]], mass: str, rounds: int = 100, tol: float = 1e-10) -> list[dict[str, float]]:
    """Multipliers of each category so that the tilted mass of every category meets its target.

    Minimises sum(mass * (w ln w - w + 1)) under sum of mass * w over a category = target, by Newton steps on the convex dual
    sum(mass * exp(multipliers)) - targets . multipliers. In each step the tasks sum up gradient and Hessian over their
    part of `cells`, by the numbers of its categories and the broadcast multipliers; only sums for categories and pairs of
    them come back. Where margins bind each other the least-squares step is taken. tol: greatest
    deviation from a target, as a part of it. The driver holds a few numbers for each
    category and pair, so there may be millions.
    """
    names = [(k, c) for k, t in enumerate(targets) for c in t]
    place = {n: i for i, n in enumerate(names)}
    goal = np.array([targets[k][c] for k, c in names])
    if not len(names):
        return [{} for _ in targets]
    spark = cells.sparkSession
    scale = max(goal.sum(), 1e-300)
    goal = goal / scale
    x = np.zeros(len(names))
    numbered = cells
    for k, m in enumerate(margins):
        of = spark.createDataFrame([(c, i) for (kk, c), i in place.items() if kk == k], "_c string, _i bigint")
        numbered = numbered.join(F.broadcast(of), col(m) == F.col("_c"), "left").withColumn(f"_{k}", F.coalesce("_i", F.lit(-1))).drop("_c", "_i")
    numbered = numbered.select(*(f"_{k}" for k in range(len(margins))), col(mass).cast("double").alias("_m")).checkpoint()
    n = len(margins)

    def sums(v: np.ndarray) -> tuple[float, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast(np.append(v, 0.0))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [batch.column(k).to_numpy() for k in range(n)]
                tilted = batch.column(n).to_numpy() * np.exp(sum(shared.value[a] for a in at))
                left = np.concatenate([np.full(len(tilted), -2), *(at[k] for k in range(n) for _ in range(n))])
                right = np.concatenate([np.full(len(tilted), -2), *(at[k] for _ in range(n) for k in range(n))])
                pairs, which = np.unique(np.stack([left, right], 1), axis=0, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.bincount(which.ravel(), np.tile(tilted, 1 + n * n), len(pairs)))], ["a", "b", "s"])

        parts = numbered.mapInArrow(add, "a bigint, b bigint, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).toPandas().sort_values(["a", "b"])
        shared.unpersist()
        a, b, s = (parts[c].to_numpy() for c in ("a", "b", "s"))
        s = s / scale
        total = float(s[a == -2].sum())
        a, b, s = (y[(a >= 0) & (b >= 0)] for y in (a, b, s))
        grad = np.bincount(a[a == b], s[a == b], len(v)) - goal
        return total - float(goal @ v), grad, (a, b, s)

    value, grad, hess = sums(x)
    for _ in range(rounds):
        if (np.abs(grad) <= tol * goal).all():
            break
        step = _solve(*hess, -grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        new = sums(x + step)
        while new[0] > value + 1e-4 * grad @ step + 1e-15 and np.abs(step).max() > 1e-12:
            step /= 2
            new = sums(x + step)
        x = x + step
        value, grad, hess = new
        if np.abs(step).max() <= 1e-12:
            break  # margins that contradict each other: as near as it gets
    return [{c: float(x[place[k, c]]) for c in t} for k, t in enumerate(targets)]


def _category(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("null"))


def _six(x: Column) -> Column:
    """A positive number to six digits, however small it is."""
    unit = F.pow(F.lit(10.0), F.lit(5.0) - F.floor(F.log10(x)))
    return F.round(x * unit) / unit


def _multipliers(counted: DataFrame, margins: list[str], tokens: str, targets: Mapping[str, float] | None, temperature: float) -> list[dict[str, float]]:
    """For each margin the multipliers of its categories; a source without weight has none."""
    keys = [f"m{i}" for i in range(len(margins))]
    cells = counted.select(*(_category(m).alias(k) for m, k in zip(margins, keys)), col(tokens).alias("t")).groupBy(*keys).agg(F.sum("t").cast("double").alias("t")).where("t > 0").checkpoint()
    found = [{r[0]: r[1] for r in cells.groupBy(k).agg(F.sum("t")).collect()} for k in keys]
    total = sum(found[0].values())
    if targets is None:
        weight = {s: t**temperature for s, t in found[0].items()}
    else:
        weight = {s: targets[name] for s in found[0] for name in [None if s == "null" else s[1:]] if targets.get(name, 0) > 0}
    whole = sum(weight.values())
    goals: list[Mapping[str, float]] = [{s: total * weight[s] / whole for s in sorted(weight)}, *({c: m[c] for c in sorted(m)} for m in found[1:])]
    if not weight:
        return [{} for _ in keys]
    chosen = counted.sparkSession.createDataFrame([(s,) for s in weight], "_c string")
    return balance(cells.join(F.broadcast(chosen), F.col("m0") == F.col("_c"), "left_semi"), keys, goals, "t")


def _rated(docs: DataFrame, margins: list[str], tilts: list[dict[str, float]], targets: Mapping[str, float] | None, rate: str) -> DataFrame:
    """`docs` with the rate of each document: exp of the sum of the multipliers of its categories, joined from tables of them."""
    out, tilt = docs, F.lit(0.0)
    for k, (m, t) in enumerate(zip(margins, tilts)):
        c, v = free_name(docs, f"_c{k}"), free_name(docs, f"_v{k}")
        of = docs.sparkSession.createDataFrame(list(t.items()), f"`{c}` string, `{v}` double")
        # a row of the table is some 60 bytes; Spark chooses the way of the join beyond 1 million
        out = out.join(F.broadcast(of) if len(t) <= MANY else of, _category(m) == col(c), "left")
        tilt = tilt + F.coalesce(col(v), F.lit(0.0))
    made = _six(F.exp(tilt))
    if targets is not None:
        named = ["null" if name is None else f"={name}" for name, w in targets.items() if w > 0]
        with_weight = free_name(docs, "_w0")
        of = docs.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(named)], f"`{with_weight}` string")
        out = out.join(F.broadcast(of) if len(named) <= MANY else of, _category(margins[0]) == col(with_weight), "left")
        made = F.when(col(with_weight).isNotNull(), made).otherwise(F.lit(0.0))
    return out.select(*map(col, docs.columns), made.alias(rate))


def _copies(id_col: str, rate: str) -> Column:
    """The rate's whole part, and one more with the probability of the rest, drawn from a hash of the id."""
    draw = F.conv(F.substring(F.md5(F.coalesce(col(id_col).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(col(rate)) + (draw < col(rate) - F.floor(col(rate))).cast("int")).cast("int")


def mix_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = 0.7, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep_margins: tuple[str, ...] = (), tokens: Column | None = None, names: tuple[str, str, str] = ("n_tokens", "rate", "copies")) -> DataFrame:
    """`docs` with tokens, rate and copies of each document, so that the sources' tokens get the target weights.

    targets: weight of each source; one that is not named gets none. Without it a source weighs its tokens to the power
    `temperature`, which draws small sources up and large ones down. The total of tokens stays as it is. keep_margins names
    columns whose categories keep their tokens. tokens: how many a document has, by default runs without white space.

    A document's rate is exp of the multipliers of its categories, to six significant digits, so that no source of a small
    weight vanishes; copies are the rate's whole part and one more with the probability of the rest, drawn from a hash of
    the id: no state, the same again after a lost task, and equal for rows with one id. A null source is a source of its own,
    a null id an id of its own; documents of a source without weight get 0, of one that has no tokens to balance 1; an empty
    table stays empty. Columns of `docs` pass through whatever their names; ValueError if one has one of the `names`.
    """
    check_free(docs.columns, names)
    ready_for_checkpoint(docs.sparkSession)
    margins, (n, r, c) = [source_col, *keep_margins], names
    counted = docs.withColumn(n, tokens if tokens is not None else token_count(col(text_col)))
    tilts = _multipliers(counted, margins, n, targets, temperature)
    return _rated(counted, margins, tilts, targets, r).withColumn(c, _copies(id_col, r))


def mix_copies(docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = 0.7, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep_margins: tuple[str, ...] = (), vocab_path: str | None = None) -> DataFrame:
    """Each document as often as its copies in `mix_rates`, with the columns of `docs`, whatever their names.

    vocab_path: weights are of tokens of this vocabulary, counted by rank-synchronous merging. Ties, nulls and empty tables as there.
    """
    ready_for_checkpoint(docs.sparkSession)
    margins = [source_col, *keep_margins]
    if vocab_path is None:
        counted = docs.select(*(col(m).alias(f"k{i}") for i, m in enumerate(margins)), token_count(col(text_col)).alias("t"))
    else:
        counted = counted_by(docs, vocab_path, margins, text_col)
    tilts = _multipliers(counted, [f"k{i}" for i in range(len(margins))], "t", targets, temperature)
    rate, copies = free_name(docs, "_rate"), free_name(docs, "_copies")
    rated = _rated(docs, margins, tilts, targets, rate).withColumn(copies, _copies(id_col, rate)).where(col(copies) > 0)
    return rated.withColumn(rate, F.explode(F.array_repeat(F.lit(0), col(copies)))).select(*map(col, docs.columns))
