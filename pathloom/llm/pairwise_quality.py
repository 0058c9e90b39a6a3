"""Quality classifier by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.frames import check_free, col, map_texts
from pathloom.llm.textbatch import LETTER, NUMBER, OTHER, SPACE, Texts, classes, hashes, words

FEATURES = ("log_bytes", "letters", "numbers", "spaces", "others", "upper", "word_length", "repeats", "bars", "runs", "lines", "stops", "wide", "long_words", "symbols", "log_words")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"%$&*#|<>{}[]\\^~=+@_", np.uint8))


def features(texts: Texts) -> np.ndarray:
    """One row of FEATURES for each document, from all of its bytes; an empty document has zeros."""
    n, data, offsets = len(texts), texts.data, texts.offsets
    size = np.diff(offsets).astype(float)
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    kind = classes(data)

    doc = np.repeat(np.arange(n), np.diff(offsets))
    bytes_ = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    kinds = np.bincount(doc * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)

    starts, ends, first = words(texts, kind)
    n_words = np.diff(first).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[first[1:]] - total[first[:-1]]).astype(float)

    code = hashes(data, starts, ends)
    again = np.zeros(len(code), bool)
    if len(code) > 1:
        again[1:] = code[1:] == code[:-1]
        again[first[:-1][first[:-1] < len(code)]] = False
    other = kind == OTHER
    run = other & np.concatenate([[False], other[:-1]])
    run[offsets[:-1][offsets[:-1] < len(data)]] = False
    count, n_bytes, letters = np.maximum(n_words, 1), np.maximum(size, 1), kinds[:, LETTER]
    out = [
        np.log1p(size),
        letters / n_bytes,
        kinds[:, NUMBER] / n_bytes,
        kinds[:, SPACE] / n_bytes,
        kinds[:, OTHER] / n_bytes,
        bytes_[:, 65:91].sum(1) / np.maximum(letters, 1),
        per_word(ends - starts) / count / 10,
        per_word(again) / count,
        np.sqrt(bytes_[:, 124] / count),
        np.sqrt(np.bincount(doc[np.flatnonzero(run)], minlength=n) / count),
        np.sqrt(bytes_[:, 10] / n_bytes),
        (bytes_[:, 46] + bytes_[:, 44]) / np.maximum(kinds[:, OTHER], 1),
        bytes_[:, 128:].sum(1) / n_bytes,
        per_word(ends - starts >= 15) / count,
        np.sqrt(bytes_[:, _SYMBOLS].sum(1) / n_bytes),
        np.log1p(n_words),
    ]
    out = np.stack(out, 1)
    out[size == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """score = (features - mean) / scale . weights; P(bad) = 1 / (1 + exp(slope * score + offset))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def bad(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.slope * score + self.offset, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic loss with a ridge, by damped Newton steps."""
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * v @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """Bradley-Terry weights from pairs of a good and a bad document, then the scale of the scores; None without both kinds."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not a.size or not b.size:
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]
    half = rng.random(pairs) < 0.5  # both orders, or the loss has no negative case
    diff[half] *= -1
    weights = _logistic(diff, (~half).astype(float), ridge)
    s = z @ weights
    slope, offset = _logistic(np.stack([s, np.ones(len(s))], 1), good.astype(float), 1e-4)
    return Model(mean, scale, weights, float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on at most about `max_labelled` labelled documents, chosen by a hash of the id among all that have a label.

    Rows without an id or label are left out; of rows with one id, one counts; label 1 is good, any other bad.
    """
    marked = labels.select(col(id_col).alias("id"), col(label_col).alias("label")).dropna()
    n = marked.count()
    share = min(1.0, max_labelled / max(n, 1))
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).groupBy("id").agg(F.min("label").alias("label"))
    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most max_labelled rows

    def start():
        return lambda texts: [list(features(texts))]

    made = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = map_texts(few.dropna(), ["id", "label"], "text", start, made, limit=CHUNK).groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("id").toPandas()
    if not len(rows):
        return None
    return fit(np.stack(rows["x"]), rows["label"].to_numpy() == 1)


BINS = 1000  # a unit of score
CHUNK = 2 << 20  # bytes at work at once


def _scored(docs: DataFrame, model: Model, text_col: str, keep: list[str], names: list[str], limit: float | None = None) -> DataFrame:
    def start():
        def work(texts: Texts) -> list:
            score = np.clip(model.score(features(texts)), -64, 64)
            size = np.diff(texts.offsets)
            made = {0: score, 1: model.bad(score)}
            return [*(made[i] for i in range(len(names))), (size > 0) & (np.floor(score * BINS) >= (-1e9 if limit is None else limit))]

        return work

    return map_texts(docs, keep, text_col, start, T.StructType([T.StructField(n, T.DoubleType()) for n in names]), filtered=True, limit=CHUNK)


def threshold(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[float, float]:
    """The quantile level and the score, in bins, below which documents go.

    The level is the share of bad documents, estimated as the mean of P(bad) over all documents; the score is the quantile
    of that level over all documents. So a clean corpus loses next to nothing and a dirty one its worst part.
    """
    scored = _scored(docs, model, text_col, [], ["score", "bad"])
    bins = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).orderBy("bin").toPandas()
    if not len(bins):
        return 0.0, -1e9
    total, level = bins["n"].sum(), float(bins["bad"].sum() / bins["n"].sum())
    under = np.concatenate([[0], np.cumsum(bins["n"].to_numpy())])[:-1]
    return level, float(bins["bin"].to_numpy()[under <= level * total + 1e-9].max())


def quality_classifier(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, max_labelled: int = 20_000, text_col: str = "text", id_col: str = "doc_id", columns: list[str] | None = None, score_col: str | None = None) -> DataFrame:
    """The documents at or above the score quantile, with `columns` (all by default), and the score if it gets a name.

    The model is fitted on labelled rows of `training` (`docs` by default). Without labels of both kinds nothing can be
    learned: all documents with text stay and their score is null. A null or empty text is rejected. Documents with a tied
    score, in particular repeated rows, fare alike: at the threshold they stay. An empty table stays empty. Columns pass
    through whatever their names; ValueError if one of them is called as `score_col`.
    """
    keep = list(docs.columns if columns is None else columns)
    check_free(keep, [score_col] if score_col else [])
    model = train(docs if training is None else training, labels, max_labelled, id_col, text_col)
    if model is None:
        out = docs.where(F.length(col(text_col)) > 0).select(*map(col, keep))
        return out.withColumn(score_col, F.lit(None).cast("double")) if score_col else out
    _, limit = threshold(docs, model, text_col)
    return _scored(docs, model, text_col, keep, [score_col] if score_col else [], limit)
