"""URL filter by the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.frames import check_free, col, ready_for_checkpoint
from pathloom.llm.textbatch import Texts, chunks, tidy

REJECTED_HOSTS = r"(?i)^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#]*[.-])?(?:ads|adult|bets?|casino|escorts?|pills|porn|spam|viagra|warez|xxx)(?:[.-][^/?#]*)?(?:[/?#:]|$)"


@dataclass(frozen=True)
class Params:
    """order: longest context in bytes, at most 6. prior: how many observations the shorter context is worth.

    bins: score steps in a unit when calibrating. frequent: how many of the most frequent grams are scored where URLs are read;
    all others are joined.
    """

    order: int = 4
    prior: float = 2.0
    bins: int = 200
    frequent: int = 1 << 16


def keys(texts: Texts, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each position, and the URL of each position.

    A URL is read byte by byte with an end sign; before its start there are start signs. A gram is a number of order + 1
    bytes: the character is the lowest, the bytes before it follow; so its last bytes are the gram of a shorter context.
    """
    n, k = len(texts), p.order
    size = np.diff(texts.offsets)
    width = size + k + 1
    begin = np.cumsum(width) - width
    flat = np.full(int(width.sum()), 2, np.int64)
    owner = np.repeat(np.arange(n), size)
    flat[np.arange(len(texts.data)) - texts.offsets[owner] + begin[owner] + k] = texts.data
    flat[begin + k + size] = 3
    at = np.arange(len(flat))
    at = at[at - np.repeat(begin, width) >= k]
    out = np.zeros(len(at), np.int64)
    for o in range(k + 1):
        out |= flat[at - o] << 8 * o
    return out, np.repeat(np.arange(n), size + 1)


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


COUNTS = ("good", "bad", "good1", "bad1")  # of all URLs, and of those of the second half


def _of_order(grams: DataFrame, order: int) -> DataFrame:
    """Rows (key, context, counts) of the grams with a context of that many bytes."""
    short = F.col("key").bitwiseAND(F.lit(_mask(order)))
    return grams.groupBy(short.alias("key")).agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumn("context", F.shiftright("key", 8))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("context").agg(*(F.sum(c).alias(f"all_{c}") for c in COUNTS))


# counts that each model is made of: all URLs, and for those of one half the URLs of the other
MODELS = {"": lambda c, kind: c(kind), "0": lambda c, kind: c(kind + "1"), "1": lambda c, kind: c(kind) - c(kind + "1")}


@dataclass(frozen=True)
class Model:
    """Exact counts (key, good, bad, good1, bad1) of every gram of the table in accepted and in rejected URLs."""

    grams: DataFrame

    def ratios(self, p: Params) -> DataFrame:
        """Rows (key, n, ratio, ratio0, ratio1): ln p(accepted) - ln p(rejected) of every gram, by all URLs, and for URLs of
        either half by those of the other; each order is smoothed by the one below it."""
        below = None
        for o in range(p.order + 1):
            counts = _of_order(self.grams, o)
            rows = counts.join(_totals(counts), "context")
            if below is not None:
                rows = rows.withColumn("shorter", F.col("key").bitwiseAND(F.lit(_mask(o - 1)))).join(below.withColumnRenamed("key", "shorter"), "shorter")
            made = []
            for name, count in MODELS.items():
                for x in ("good", "bad"):
                    under = F.lit(1 / 256) if below is None else F.col(f"p_{x}{name}")
                    seen, whole = count(F.col, x), count(lambda c: F.col(f"all_{c}"), x)
                    made.append(((seen + p.prior * under) / (whole + p.prior)).alias(f"q_{x}{name}"))
            below = rows.select("key", (F.col("good") + F.col("bad")).alias("n"), *made)
            below = below.toDF(*(c.replace("q_", "p_") for c in below.columns))
            below = below if o == p.order else below.drop("n")
        return below.select("key", "n", *((F.log(f"p_good{m}") - F.log(f"p_bad{m}")).alias(f"ratio{m}") for m in MODELS))

    def scores(self, texts: Texts, p: Params) -> np.ndarray:
        """Mean of the ratios over the characters of a few URLs, which need not be of the table."""
        gram, owner = keys(texts, p)
        probs = np.full((2, len(gram)), 1 / 256)
        for o in range(p.order + 1):
            short = gram & _mask(o)
            counts = _of_order(self.grams, o)
            for table, key, name, wanted in ((counts, "key", "", short), (_totals(counts), "context", "all_", short >> 8)):
                asked = self.grams.sparkSession.createDataFrame([(int(x),) for x in np.unique(wanted)], f"{key} bigint")
                found = {r[0]: r[1:] for r in table.join(F.broadcast(asked), key).select(key, f"{name}good", f"{name}bad").collect()}
                seen = np.array([found.get(x, (0, 0)) for x in wanted.tolist()], float).reshape(-1, 2).T
                probs = seen + p.prior * probs if key == "key" else probs / (seen + p.prior)
        log = np.log(probs)
        return np.bincount(owner, log[0] - log[1], len(texts)) / np.bincount(owner, minlength=len(texts))


def _urls(pages: DataFrame, url_col: str, rejected: Column) -> DataFrame:
    """Rows (no, url, good, bad, half): each URL in lower case, how many of its rows are labelled as accepted and as rejected,
    and in which half a hash puts it."""
    ready_for_checkpoint(pages.sparkSession)
    rows = pages.select(F.lower(col(url_col)).alias("url"), rejected.alias("bad")).where("url is not null")
    each = rows.groupBy("url").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    return each.select(F.monotonically_increasing_id().alias("no"), "url", "good", "bad", F.pmod(F.xxhash64("url"), F.lit(2)).alias("half")).checkpoint()


def _fit(urls: DataFrame, p: Params) -> Model | None:
    """Counts over every URL, those without a label included with 0; None if one kind is missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bad, half = (batch.column(i).to_numpy() for i in (1, 2, 3))
            for texts in chunks(batch.column(0), 1 << 20):
                gram, owner = keys(texts, p)
                key, where = np.unique(gram, return_inverse=True)
                part = slice(texts.first_row, texts.first_row + len(texts))
                sums = [np.bincount(where, x[part][owner], len(key)).astype(np.int64) for x in (good, bad, good * half, bad * half)]
                for s in range(0, len(key), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000]) for x in (key, *sums)], ["key", *COUNTS])

    counted = urls.select("url", "good", "bad", "half").mapInArrow(tidy(count), "key bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    grams = counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS)).checkpoint()
    both = urls.agg(F.sum("good"), F.sum("bad")).first()
    return Model(grams) if both[0] and both[1] else None


def train(pages: DataFrame, url_col: str, rejected: Column, p: Params = Params()) -> Model | None:
    """Both models' counts over every URL of the table, as a table of Spark that grows with it; None if one kind is missing."""
    return _fit(_urls(pages, url_col, rejected), p)


def _score(urls: DataFrame, model: Model, p: Params) -> DataFrame:
    """Rows (no, score, other) for each URL, the mean of the ratios of its grams; other: by the half that it is not in.

    The most frequent grams are summed up where URLs are read, so that no key of the join is in most of the URLs; every other
    gram of a URL is joined with its ratios.
    """
    ratios = model.ratios(p).checkpoint()
    top = ratios.orderBy(F.desc("n"), "key").limit(p.frequent).select("key", "ratio", "ratio0", "ratio1").checkpoint().toPandas().sort_values("key")  # by way of one task, not of the driver
    shared = urls.sparkSession.sparkContext.broadcast((top["key"].to_numpy(np.int64), top[["ratio", "ratio0", "ratio1"]].to_numpy(float)))
    names = ["no", "half", "key", "ratio", "other", "size"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, worth = shared.value
        for batch in batches:
            number, halves = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for texts in chunks(batch.column(1), 1 << 20):
                part = slice(texts.first_row, texts.first_row + len(texts))
                no, half = number[part], halves[part]
                gram, owner = keys(texts, p)
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                here = known[at] == gram
                total = [np.bincount(owner[here], w, len(texts)) for w in (worth[at[here], 0], worth[at[here], 1 + half[owner[here]]])]
                size = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(half), pa.nulls(len(no), pa.int64()), *map(pa.array, total), pa.array(size.astype(np.int64))], names)
                rare, of = gram[~here], owner[~here]
                for s in range(0, len(rare), 50_000):
                    k, o = rare[s : s + 50_000], of[s : s + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(no[o]), pa.array(half[o]), pa.array(k), *[pa.array(np.zeros(len(k)))] * 2, pa.array(np.zeros(len(k), np.int64))], names)

    parts = urls.select("no", "url", "half").mapInArrow(tidy(read), "no bigint, half bigint, key bigint, ratio double, other double, size bigint").checkpoint()
    other = F.when(F.col("half") == 0, F.col("ratio0")).otherwise(F.col("ratio1"))
    joined = parts.where("key is not null").select("no", "half", "key").join(ratios.drop("n"), "key").select("no", "ratio", other.alias("other"), F.lit(0).cast("bigint").alias("size"))
    every = parts.where("key is null").select("no", "ratio", "other", "size").union(joined)
    return every.groupBy("no").agg(*(F.round(F.sum(c) / F.sum("size"), 9).alias(name) for c, name in (("ratio", "score"), ("other", "other"))))


def threshold(scored: DataFrame, p: Params = Params(), score_col: str = "other") -> tuple[float, float]:
    """The score that parts the two kinds best, over all URLs, and its error: the share of accepted ones below it plus that of
    rejected ones at or above it. Of several such scores the middle one. By default each URL is scored by the models of the
    half that it is not in, so neither has seen it."""
    bins = scored.groupBy(F.floor(F.col(score_col) * p.bins).alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where("good + bad > 0").orderBy("bin").toPandas()
    good, bad, bin_ = bins["good"].to_numpy(float), bins["bad"].to_numpy(float), bins["bin"].to_numpy(np.int64)
    wrong = np.concatenate([[0], np.cumsum(good)]) / good.sum() + 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(best[len(best) // 2])  # rejected are the first k bins
    edge = [bin_[0] - 1, *bin_, bin_[-1] + 2]
    return float((edge[k] + edge[k + 1] + 1) // 2) / p.bins, float(wrong[k])


def url_filter(pages: DataFrame, rejected: Column | None = None, p: Params = Params(), url_col: str = "url", columns: list[str] | None = None, score_col: str = "score", labels: DataFrame | None = None) -> DataFrame:
    """The rows whose URL scores at or above the threshold, with `columns` (all by default) and the score.

    labels: a table (url, rejected) of labelled URLs. Without it `rejected` is a condition that labels them, by default host
    names with words of known unwanted kinds, which are but seeds: the models generalise from their characters. A URL without
    a label (null) is not trained on. Counts cover all URLs; the threshold is calibrated on all of them too, each scored by
    models of the half of the URLs that it is not in; where a half has no labelled URL of one kind, there is nothing to hold out
    and the models of all do it. Then the models of all judge every row, labelled or not, by its
    characters alone. URLs are compared in lower case. A null URL stays with a null score, an empty one is judged by its end
    sign; without URLs of both kinds all rows stay with a null score. Equal URLs fare alike, a label that contradicts another
    counts too; a score at the threshold stays; an empty table stays empty. Columns pass through whatever their names;
    ValueError if one is called as `score_col`.
    """
    keep = list(pages.columns if columns is None else columns)
    check_free(keep, [score_col])
    rejected = F.regexp_like(col(url_col), F.lit(REJECTED_HOSTS)) if rejected is None else rejected
    urls = _urls(pages, url_col, F.lit(None).cast("boolean") if labels is not None else rejected)
    if labels is not None:
        told = labels.select(F.lower("url").alias("of"), F.col("rejected").cast("boolean").alias("bad")).groupBy("of").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
        urls = urls.drop("good", "bad").join(told, F.col("url") == F.col("of"), "left").select("no", "url", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad")), "half").checkpoint()
    model = _fit(urls, p)
    if model is None:
        return pages.select(*map(col, keep)).withColumn(score_col, F.lit(None).cast("double"))
    scored = urls.join(_score(urls, model, p), "no").select("url", "good", "bad", "score", "other").checkpoint()
    halves = urls.agg(*(F.count_if((F.col(c) > 0) & (F.col("half") == h)) for c in ("good", "bad") for h in (0, 1))).first()
    limit, _ = threshold(scored, p, "other" if all(halves) else "score")
    lower = pages.select(*(col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.lower(col(url_col)).alias("url"))
    out = lower.join(scored.select("url", "score"), "url", "left").where(F.col("url").isNull() | (F.col("score") >= limit))
    return out.select(*(f"k{i}" for i in range(len(keep))), "score").toDF(*keep, score_col)
