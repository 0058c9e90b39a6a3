"""HTML extraction by a recurrent block labeller."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.frames import col
from pathloom.llm.textbatch import Texts, hashes, tidy, words

# every part is possessive: a tag costs its length, however it ends; quotes count behind "=" only, and only if they are closed
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)", re.S)
_NOT_TEXT = re.compile(r"[!?a-zA-Z]|/[a-zA-Z]")
_CLASS = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_LONG_NUMBER = re.compile(r"&#[0-9]{9,}+;?")  # beyond all characters
RAW = frozenset("script style noscript template svg textarea".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("head title option select iframe object canvas".split())
CLOSES = {"p": frozenset("p address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"])}
IN_HEAD = frozenset("base link meta title script style noscript template".split())
MAIN = frozenset(("article", "main"))
PATH, WORD, FIGURES = 40, 16, 8
CHUNK = 2 << 20  # bytes of pages at work at once
STEPS = 4096  # steps whose inputs are multiplied at once
SIZE = PATH + WORD + FIGURES


class Paths:
    """The tag paths of many pages as one tree: a node is a tag with its class names under its parent, numbered parents first.

    So a path is a number however deep it is, and its features come from those of its parent.
    """

    def __init__(self):
        self.parent, self.tag, self.marks, self.depth, self.main = [-1], [""], [()], [0], [False]
        self.shown = [0]  # the nearest node, itself included, that is no mark of a main part
        self._known: dict[tuple, int] = {}

    def child(self, parent: int, tag: str, marks: tuple[str, ...]) -> int:
        key = (parent, tag, marks)
        if key not in self._known:
            node = self._known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.marks.append(marks)
            self.depth.append(self.depth[parent] + 1)
            self.main.append(self.main[parent] or tag in MAIN)
            self.shown.append(self.shown[parent] if tag in MAIN else node)
        return self._known[key]


@dataclass(slots=True)
class Block:
    """Text between two block tags: the number of its path, the text, and how much of it lies in links."""

    paths: Paths
    node: int
    text: str
    linked: int

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """The open tags, outermost first, with their class names; inline tags left out."""
        out, at = [], self.node
        while at:
            out.append((self.paths.tag[at], self.paths.marks[at]))
            at = self.paths.parent[at]
        return tuple(reversed(out))

    @property
    def main(self) -> bool:
        return self.paths.main[self.node]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): a text ("text", "", text) or a tag ("open" or "close", its name in lower case, its attributes).

    Comments, declarations and what is inside of RAW elements are left out. A `<` that begins no tag is text, and so is a tag
    that another `<` breaks off; one that the page's end breaks off is dropped. No place is read more than a few times.
    """
    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "text", "", page[at:]
            return
        if open_ > at:
            yield "text", "", page[at:open_]
        if not _NOT_TEXT.match(page, open_ + 1):
            yield "text", "", "<"
            at = open_ + 1
            continue
        if page[open_ + 1] in "!?":
            close = page.find("-->", open_ + 4) if page.startswith("<!--", open_) else page.find(">", open_)
            at = n if close < 0 else close + (3 if page.startswith("<!--", open_) else 1)
            continue
        m = _TAG.match(page, open_)
        at = m.end()
        if at == n:
            return
        if page[at] == "<":
            yield "text", "", page[open_:at]
            continue
        at += 1
        name, rest = m[2].lower(), m[3]
        if name not in RAW:
            yield "close" if m[1] else "open", name, rest
        elif not m[1] and not (name == "svg" and rest.endswith("/")):
            end = _END[name].search(page, at)
            at = end.end() if end else n


def blocks(page: str, paths: Paths | None = None) -> list[Block]:
    """The leaf texts of a page in order. Any markup is accepted: unknown, unclosed and stray tags only shift the path.

    The work is in proportion to the page: open tags are looked up by name, and a block notes the number of its path.
    """
    paths = Paths() if paths is None else paths
    out: list[Block] = []
    stack: list[str] = []  # names of open tags
    nodes, outer = [0], [0]  # for each depth of the stack: the path, and the depth of the innermost tag that is not inline
    places: dict[str, list[int]] = {}  # where in the stack a name is open
    text: list[str] = []
    linked, links, skip = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape(_LONG_NUMBER.sub("�", "".join(text))).split())
            text.clear()
            if joined:
                out.append(Block(paths, nodes[-1], joined, min(linked, len(joined))))
        linked = 0

    def drop(at: int) -> None:
        nonlocal links, skip
        while len(stack) > at:
            gone = stack.pop()
            places[gone].pop()
            nodes.pop()
            outer.pop()
            links -= gone == "a"
            skip -= gone in SKIPPED

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if stack and stack[-1] == "head" and not rest.isspace():  # only the body has text of its own
                drop(len(stack) - 1)
            if not skip:
                text.append(rest)
                if links:
                    linked += len(rest)
            continue
        if tag not in INLINE:
            flush()
        if kind == "close":
            if places.get(tag):
                drop(places[tag][-1])
            continue
        if skip and places.get("head"):
            at = places["head"][0]
            if tag == "body" or at == len(stack) - 1 and tag not in IN_HEAD:  # its end tag may be omitted
                drop(at)
        if tag not in VOID:
            if stack and tag in CLOSES.get(stack[-1], ()):
                drop(len(stack) - 1)
            elif (tag == "p" or tag == "div") and outer[-1] and stack[outer[-1] - 1] == "p":  # an unclosed inline tag does not hold a paragraph open
                drop(outer[-1] - 1)
            inline = tag in INLINE
            marks = () if inline or not rest else tuple(w for c in _CLASS.findall(rest) for w in (c[0] or c[1] or c[2]).lower().split())
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
            nodes.append(nodes[-1] if inline else paths.child(nodes[-1], tag, marks))
            outer.append(outer[-1] if inline else len(stack))
            links += tag == "a"
            skip += tag in SKIPPED
    flush()
    return out


def _hashed(rows: list[str], size: int) -> np.ndarray:
    """Signed counts of hashed words of each row, scaled to length one."""
    out = np.zeros((len(rows), size), np.float32)
    for s in range(0, len(rows), 20_000):
        t = Texts.of(rows[s : s + 20_000])
        starts, ends, first = words(t)
        h = hashes(t.data, starts, ends)
        owner = np.repeat(np.arange(len(t)), np.diff(first))
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        out[s : s + len(t)] = np.bincount(owner * size + (h % np.uint64(size)).astype(np.int64), sign, len(t) * size).reshape(len(t), size)
    return _scaled(out)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def path_vectors(paths: Paths, hide: bool) -> np.ndarray:
    """A vector for each node: hashed tags of its whole path, the last two pairs of them, the last one, and class names of the
    last six tags. hide: as if there were no marks of a main part."""
    names: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if word not in names:
            h = xxhash.xxh64_intdigest(word)
            names[word] = (h % PATH, 1.0 if h >> 63 else -1.0)
        return names[word]

    n = len(paths.parent)
    sums = np.zeros((n, PATH), np.float32)
    rows, columns, signs = [], [], []
    above = lambda k: paths.shown[paths.parent[k]] if hide else paths.parent[k]
    for k in range(1, n):
        if hide and paths.shown[k] != k:
            continue  # seen as the node that it shows
        up = above(k)
        at, sign = place("t:" + paths.tag[k])
        sums[k] = sums[up]
        sums[k, at] += sign
        found = ["l:" + paths.tag[k], *("c:" + m for m in paths.marks[k])]
        last, step = k, up
        for i in range(5):
            if not step:
                break
            if i < 2:
                found.append(f"2:{paths.tag[step]}/{paths.tag[last]}")
            found += ["c:" + m for m in paths.marks[step]]
            last, step = step, above(step)
        for word in found:
            at, sign = place(word)
            rows.append(k)
            columns.append(at)
            signs.append(sign)
    np.add.at(sums, (np.array(rows, np.int64), np.array(columns, np.int64)), np.array(signs, np.float32))
    return _scaled(sums)[paths.shown] if hide else _scaled(sums)


def vectors(pages: list[list[Block]], hide: bool = False) -> np.ndarray:
    """A vector for each block of all pages, which share their Paths: hashed tag path, hashed words, figures. hide: no path
    shows a main part."""
    every = [b for p in pages for b in p]
    if not every:
        return np.zeros((0, SIZE), np.float32)
    paths = every[0].paths
    node = np.array([b.node for b in every])
    size = np.array([len(b.text) for b in every], np.float32)
    depth = np.array(paths.depth, np.float32)[node]
    figures = [
        np.log1p(size) / 5,
        np.array([b.linked for b in every]) / size,
        np.array([b.text.count(" ") for b in every]) / size * 5,
        np.array([sum(map(b.text.count, ".!?")) for b in every]) / size * 20,
        np.array([b.text.count(",") for b in every]) / size * 20,
        np.log1p(depth) / 2,
        np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p]),
        np.ones(len(every)),
    ]
    return np.concatenate([path_vectors(paths, hide)[node], _hashed([b.text.lower() for b in every], WORD), np.stack(figures, 1).astype(np.float32)], 1)


@dataclass
class Model:
    """Weights of an LSTM for each direction (input, recurrent, bias; gates in the order in, forget, out, cell) and of the output."""

    w: list[np.ndarray]

    @staticmethod
    def fresh(hidden: int, rng: np.random.Generator) -> Model:
        w = []
        for _ in range(2):
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            w += [rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, 4 * hidden)), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), bias]
        w += [rng.normal(0, 0.1, 2 * hidden), np.zeros(1)]
        return Model([x.astype(np.float32) for x in w])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (steps, rows, hidden) over x (steps, rows, SIZE); where the mask is 0 the state stays as it is."""
    steps, rows, _ = x.shape
    hidden = u.shape[0]
    h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    out = np.zeros((steps, rows, hidden), np.float32)
    z_in = x @ w + b
    for t in range(steps):
        z = z_in[t] + h @ u
        g = _sigmoid(z[:, : 3 * hidden])
        i, f, o = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden :]
        a = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        c_new = m * (f * c + i * a) + (1 - m) * c
        s = np.tanh(c_new)
        h_new = m * (o * s) + (1 - m) * h
        if tape is not None:
            tape.append((h, c, i, f, o, a, s, m))
        h, c = h_new, c_new
        out[t] = h
    return out


def _back(x: np.ndarray, w: np.ndarray, u: np.ndarray, tape: list, d_out: np.ndarray) -> list[np.ndarray]:
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    every = np.empty((len(tape), len(dh), w.shape[1]), d_out.dtype)
    hidden = u.shape[0]
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, a, s, m = tape[t]
        dh = dh + d_out[t]
        d = m * dh
        d_cell = dc * m + d * o * (1 - s * s)
        dz = every[t]
        dz[:, :hidden] = d_cell * a * i * (1 - i)
        dz[:, hidden : 2 * hidden] = d_cell * c * f * (1 - f)
        dz[:, 2 * hidden : 3 * hidden] = d * s * o * (1 - o)
        dz[:, 3 * hidden :] = d_cell * i * (1 - a * a)
        dh = (1 - m) * dh + dz @ u.T
        dc = (1 - m) * dc + d_cell * f
    flat = every.reshape(-1, w.shape[1])
    before = np.concatenate([t[0] for t in tape])
    return [x[: len(tape)].reshape(-1, x.shape[2]).T @ flat, before.T @ flat, flat.sum(0)]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in parts)
    x, mask = np.zeros((steps, len(parts), SIZE), np.float32), np.zeros((steps, len(parts)), np.float32)
    for k, p in enumerate(parts):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _states(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    """Hidden states (2, steps, rows, hidden): read forwards, and each row read from its own end.

    As what follows a row's end cannot change what was before, no mask is needed. sigmoid(z) is (tanh(z / 2) + 1) / 2, so all
    gates of both directions are one tanh.
    """
    steps, rows = max(map(len, parts)), len(parts)
    hidden = model.w[1].shape[0]
    half = np.concatenate([np.full(3 * hidden, 0.5, np.float32), np.ones(hidden, np.float32)])
    w, u, b = (np.stack([model.w[k], model.w[k + 3]]) * half for k in range(3))
    x = np.zeros((2, steps, rows, SIZE), np.float32)
    for k, p in enumerate(parts):
        x[0, : len(p), k], x[1, : len(p), k] = p, p[::-1]
    h, c = np.zeros((2, rows, hidden), np.float32), np.zeros((2, rows, hidden), np.float32)
    out = np.empty((2, steps, rows, hidden), np.float32)
    z = np.empty((2, rows, 4 * hidden), np.float32)
    for t in range(steps):
        if t % STEPS == 0:
            z_in = x[:, t : t + STEPS] @ w[:, None] + b[:, None, None]
        np.matmul(h, u, out=z)
        z += z_in[:, t % STEPS]
        np.tanh(z, out=z)
        g = z[:, :, : 3 * hidden] * np.float32(0.5) + np.float32(0.5)
        c = g[:, :, hidden : 2 * hidden] * c + g[:, :, :hidden] * z[:, :, 3 * hidden :]
        h = out[:, t] = g[:, :, 2 * hidden :] * np.tanh(c)
    return out


def probabilities(model: Model, parts: list[np.ndarray]) -> list[np.ndarray]:
    """P(content) of each block; a sequence of blocks for each page."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(parts)
    order = sorted((k for k in range(len(parts)) if len(parts[k])), key=lambda k: len(parts[k]))
    start = 0
    while start < len(order):
        end = min(start + 256, len(order))
        while end > start + 1 and len(parts[order[end - 1]]) * (end - start) > 20_000:
            end -= 1
        these = order[start:end]
        states = _states(model, [parts[k] for k in these])
        hidden = states.shape[-1]
        for k, i in enumerate(these):
            n = len(parts[i])
            out[i] = _sigmoid(states[0, :n, k] @ model.w[6][:hidden] + states[1, n - 1 :: -1, k][:n] @ model.w[6][hidden:] + model.w[7])
        start = end
    return out


def fit(pages: list[list[Block]], hidden: int = 16, epochs: int = 14, rate: float = 0.01, seed: int = 3) -> Model | None:
    """Train on pages (which share their Paths) that mark their main part: blocks inside <article> or <main> are content, all others are not.

    In half of the readings of a page the marks are hidden, so the network has to know content by its words, by the other
    tags and by the blocks around it. None if no page has both kinds of blocks.
    """
    rng = np.random.default_rng(seed)
    truth = [np.array([b.main for b in p], np.float32) for p in pages]
    usable = [k for k, y in enumerate(truth) if len(y) and 0 < y.sum() < len(y)]
    if not usable:
        return None
    pages, truth = [pages[k] for k in usable], [truth[k] for k in usable]
    cut = np.cumsum([len(p) for p in pages])[:-1]
    shown = np.split(vectors(pages), cut)
    hidden_ = np.split(vectors(pages, hide=True), cut)
    model = Model.fresh(hidden, rng)
    first, second, step = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w], 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for s in range(0, len(order), 24):
            these = sorted(order[s : s + 24], key=lambda k: len(pages[k]))
            x, mask = _padded([(hidden_ if rng.random() < 0.5 else shown)[k] for k in these])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(these):
                y[: len(truth[k]), j] = truth[k]
            w, tapes = model.w, ([], [])
            forth = _run(x, mask, *w[0:3], tape=tapes[0])
            back = _run(x[::-1], mask[::-1], *w[3:6], tape=tapes[1])[::-1]
            both = np.concatenate([forth, back], 2)
            d = (_sigmoid(both @ w[6] + w[7]) - y) * mask / mask.sum()
            d_both = d[:, :, None] * w[6]
            grads = [
                *_back(x, w[0], w[1], tapes[0], d_both[:, :, :hidden]),
                *_back(x[::-1], w[3], w[4], tapes[1], d_both[::-1, :, hidden:]),
                np.einsum("tb,tbh->h", d, both),
                d.sum(keepdims=True).reshape(1),
            ]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = w[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def extract_pages(model: Model | None, pages: list[str | None]) -> tuple[list[str | None], list[int | None], list[int | None]]:
    """Text, number of blocks and number of content blocks of each page."""
    paths = Paths()
    found = [blocks(p or "", paths) for p in pages]
    flat = vectors(found)
    parts = np.split(flat, np.cumsum([len(f) for f in found])[:-1]) if found else []
    keep = [np.ones(len(f), bool) for f in found] if model is None else [p >= 0.5 for p in probabilities(model, parts)]
    text = [None if p is None else "\n".join(b.text for b, k in zip(f, ks) if k) for p, f, ks in zip(pages, found, keep)]
    none = [p is None for p in pages]
    return text, [None if n else len(f) for n, f in zip(none, found)], [None if n else int(k.sum()) for n, k in zip(none, keep)]


def train(pages: DataFrame, max_pages: int = 400, max_bytes: int = 100_000, html_col: str = "html") -> Model | None:
    """Fit on about `max_pages` of the pages that mark their main part, chosen by a hash of their text, of at most `max_bytes` each."""
    marked = pages.select(col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.octet_length("html") <= max_bytes))
    share = min(1.0, max_pages / max(marked.count(), 1))
    few = marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy("html").toPandas()
    paths = Paths()
    return fit([blocks(h, paths) for h in few["html"]])


def extract_html(pages: DataFrame, max_pages: int = 400, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row (id, text, n_blocks, n_content) for each row of `pages`: the content blocks' text, one block a line.

    Every block of every page is read and labelled with the whole page as context. A null page has nulls, an empty one or one
    without text an empty text and 0. Where no page marks a main part there is nothing to learn from and all blocks count as
    content. Equal pages get equal rows, whatever else is in their batch; repeated and null ids stay as they are; an empty
    table gives no row. Other columns are not read.
    """
    model = train(pages, max_pages, html_col=html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_content", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            s = 0
            while s < batch.num_rows:  # pages of some MB at a time, or one longer page
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + CHUNK, "right")))
                text, n, content = extract_pages(shared.value, batch.column(1).slice(s, e - s).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(content, pa.int64())], kind.names)
                s = e

    out = pages.select(col(id_col).alias("id"), col(html_col).alias("html")).mapInArrow(tidy(run), kind)
    return out.withColumnRenamed("id", id_col)
