"""The operators: validate, paths, match, extract, values, visit, summarise."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from pathloom.functions.json import encoded, is_valid, kind_of, parsed, segments_of, split_path, valid_text, variant_paths
from pathloom.operators.walk import Shapes, count_paths, dump, every_path, kind, load, look_up, matching_paths
from pathloom.plans.automaton import Automaton, Observed, decode_path, depth, literal_paths, observed_regex, to_regex
from pathloom.plans.syntax import Group, PathExpr, parse

Exprs = str | PathExpr | Sequence[str | PathExpr]
BATCH = 4096  # rows of a result batch
NODES = 100_000  # different paths that a task counts at once
LEVELS = 1_100  # Spark reads no deeper documents
SEMANTICS, ARRAY_MODES, STRATEGIES = ("spec", "observed"), ("index", "elementwise"), ("auto", "direct", "walk")


def _exprs(exprs: Exprs) -> list[PathExpr]:
    return [parse(e) if isinstance(e, str) else e for e in ([exprs] if isinstance(exprs, (str, PathExpr)) else exprs)]


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _one_of(what: str, given: str, known: tuple[str, ...]) -> None:
    if given not in known:
        raise ValueError(f"unknown {what} {given!r}, not one of {known}")


def _free(columns: Iterable[str], made: Iterable[str]) -> None:
    """ValueError if a column that comes along is named twice or as one that is made; compared without case, as in Spark."""
    names = [c.lower() for c in (*columns, *made)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"the result would have more than one column {twice}: rename those of the table")


def with_validity(df: DataFrame, json_col: str = "json", valid_col: str = "valid") -> DataFrame:
    """`df` with a column that tells whether the text is a JSON document. ValueError if `df` has a column of that name."""
    _free(df.columns, [valid_col])
    return df.withColumn(valid_col, is_valid(_c(json_col)))


def _value(value: Column, kind: str) -> Column:
    """A VARIANT as it is, as JSON text, or cast to a SQL type (null where that fails)."""
    if kind == "variant":
        return value
    return F.to_json(value) if kind == "json" else F.try_variant_get(value, "$", kind)


def _shown(kept: Sequence[str], df: DataFrame, kind: str) -> DataFrame:
    """The result with its column `value` as the caller wants it."""
    if kind == "kind":
        return df
    return df.select(*map(_c, kept), _value(F.parse_json("value"), kind).alias("value"))


def _clean(text: str) -> str:
    """A text that UTF-8 can hold: half of a surrogate pair becomes a question mark, as in the JVM."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _told(path: str, segments: tuple[str, ...]) -> tuple[str, Sequence[str]]:
    return (path, segments) if path.isascii() else (_clean(path), [_clean(s) for s in segments])


Fields = list[tuple[str, T.DataType, pa.DataType]]


def _walk(df: DataFrame, json_col: str, keep: list[str], fields: Fields, visit) -> DataFrame:
    """Run visit(document) -> rows of `fields` over every valid document, in one pass without a shuffle.

    Invalid documents are left out by Spark's own parser before, so both agree on what is valid.
    """

    def run(text: str | None) -> Iterable[tuple]:
        return () if text is None else visit(load(text))

    return _rows_of(df, [valid_text(_c(json_col))], keep, fields, run)


def _rows_of(df: DataFrame, given: list[Column], keep: list[str], fields: Fields, visit) -> DataFrame:
    """Run visit(values of `given`) -> rows of `fields` over every row, in one pass without a shuffle."""
    inner = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep)), *(T.StructField(n, t) for n, t, _ in fields)])
    names, types = schema.names, [t for _, _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []

            def result() -> pa.RecordBatch:
                taken = [batch.column(i).take(pa.array(source, pa.int64())) for i in range(len(inner))]
                return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(inner) :]))):
                for made in visit(*row):
                    rows.append(made)
                    source.append(i)
                    if len(rows) >= BATCH:
                        yield result()
                        rows.clear()
                        source.clear()
            if rows:
                yield result()

    asked = df.select(*(_c(c).alias(n) for n, c in zip(inner, keep)), *(g.alias(f"g{i}") for i, g in enumerate(given)))
    return asked.mapInArrow(run, schema).toDF(*keep, *(n for n, _, _ in fields))


_PATH = ("path", T.StringType(), pa.string())
_SEGS = ("segments", T.ArrayType(T.StringType()), pa.list_(pa.string()))
_VALUE = ("value", T.StringType(), pa.string())
_NUMBERS = ("pattern_id", T.IntegerType(), pa.int32())


def paths(df: DataFrame, json_col: str = "json", keep: Sequence[str] = ("doc_id",), value: str | None = None, strategy: str = "walk", leaves: bool = False, segments: bool = True) -> DataFrame:
    """Rows (kept columns, path[, segments][, value]): every path of every valid document, root and containers included.

    segments are the true keys and indices, whatever dots and brackets a key holds, and can be left out; `path` is for display. value: "variant",
    "json", a SQL type, or "kind" for the kind of each value, which needs no text of it. leaves: only paths of what holds no
    other, which keeps values of containers, written once for each that they are in, out of the result. strategy "walk" is
    one pass over the rows; "recursive" is a recursive query over VARIANT, one round a level. ValueError if a kept column has
    the name of one that is made.
    """
    _one_of("strategy", strategy, ("walk", "recursive"))
    keep, made = list(keep), ["path", *(["segments"] if segments else []), *(["value"] if value else [])]
    _free(keep, made)
    if strategy == "recursive":
        out = _recursive(df, json_col, keep)
        if leaves:
            out = out.where(~kind_of(F.col("value")).isin("object", "array") | F.to_json("value").isin("{}", "[]"))
        of = kind_of(F.col("value")) if value == "kind" else _value(F.col("value"), value) if value else None
        return out.select(*map(_c, keep), *made[: 1 + segments], *([of.alias("value")] if value else []))
    fields = [_PATH, *([_SEGS] if segments else []), *([_VALUE] if value else [])]
    tell = kind if value == "kind" else lambda found: _clean(dump(found))

    def visit(document: object):
        for path, keys, found in every_path(document):
            if not (leaves and found and isinstance(found, (dict, list))):
                yield (*_told(path, keys)[: 1 + segments], *([tell(found)] if value else []))

    out = _walk(df, json_col, keep, fields, visit)
    return _shown([*keep, *made[: 1 + segments]], out, value) if value else out


def count_kinds(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Rows (path, kind, n): the paths of all valid documents, root and containers included, with the kinds of what is there.

    Indices are left out: `[3]` reads `[]`, also inside a key. The tasks count, so only different paths travel, not values;
    a task that has seen NODES of them hands them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()

        def counted() -> Iterator[pa.RecordBatch]:
            rows = shapes.rows()
            while some := list(islice(rows, BATCH)):
                path, kinds, n = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(map(_clean, path), pa.string()), pa.array(kinds, pa.string()), pa.array(n, pa.int64())], ["path", "kind", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    shapes.add(load(text, numbers=False))
                if shapes.size >= NODES:
                    yield from counted()
                    shapes = Shapes()
        yield from counted()

    told = df.select(valid_text(_c(json_col)).alias("json")).mapInArrow(run, "path string, kind string, n bigint")
    return told.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def visit_nodes(df: DataFrame, visit: Callable[[str, tuple[str, ...], object], Iterable[tuple]], schema: str | T.StructType, json_col: str = "json", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows (kept columns, columns of `schema`): whatever visit(path, segments, value) returns for each node of each valid document.

    A value is a dict, a list, a str, a bool, None, or a `walk.Number`, a str with the text of a number. The function runs on
    the executors. ValueError if a kept column has the name of one of the schema.
    """
    kind_ = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    _free(keep, kind_.names)
    arrow = to_arrow_schema(kind_)
    fields = [(f.name, f.dataType, arrow.field(i).type) for i, f in enumerate(kind_.fields)]

    def every(document: object):
        for node in every_path(document):
            yield from visit(*node)

    return _walk(df, json_col, list(keep), fields, every)


def _recursive(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """All nodes by a recursive common table expression, as deep as Spark's parser reads documents and without a limit of rows."""
    spark = df.sparkSession
    base = df.select(*(_c(c).alias(f"k{i}") for i, c in enumerate(keep)), parsed(_c(json_col)).alias("v")).where("v is not null")
    keys = ", ".join(f"k{i}" for i in range(len(keep)))
    query = f"""
      WITH RECURSIVE nodes({keys}, path, segments, v) MAX RECURSION LEVEL {LEVELS} AS (
        SELECT {keys}, '$', CAST(array() AS ARRAY<STRING>), v FROM {{base}}
        UNION ALL
        SELECT {', '.join(f'n.k{i}' for i in range(len(keep)))},
          CASE WHEN e.key IS NULL THEN concat(n.path, '[', e.pos, ']') ELSE concat(n.path, '.', e.key) END,
          array_append(n.segments, coalesce(e.key, CAST(e.pos AS STRING))), e.value
        FROM nodes n, LATERAL variant_explode(n.v) e
      ) SELECT * FROM nodes LIMIT ALL"""
    return spark.sql(query, base=base).toDF(*keep, "path", "segments", "value")


def extract(df: DataFrame, exprs: Exprs, json_col: str = "json", keep: Sequence[str] = ("doc_id",), value: str = "json", semantics: str = "spec", array_mode: str = "index", which: bool = False, strategy: str = "auto") -> DataFrame:
    """Rows (kept columns[, pattern_id], path, segments, value): the values at all paths that the expressions match.

    exprs: one expression or several; a path that several match appears once, or with `which` once for each with its number.
    value: "variant", "json" for JSON text, or a SQL type for a cast that gives null where it fails.
    semantics: "spec" as the language is defined; "observed" with the quirks of `Observed`, on flattened paths.
    array_mode: "index", where an element's index is a segment, or "elementwise", where a pattern goes on in every element.
    strategy: "direct" looks finitely many literal paths up in the VARIANT, all inside Spark and parsed once; "walk" walks each
    document along the ways the patterns allow; "auto" takes the first where it can. Invalid documents give no rows.
    ValueError for an unknown option, one that the observed semantics do not know, or a kept column with the name of one made.
    """
    found, keep = _exprs(exprs), list(keep)
    for what, given, known in (("semantics", semantics, SEMANTICS), ("array mode", array_mode, ARRAY_MODES), ("strategy", strategy, STRATEGIES)):
        _one_of(what, given, known)
    made = [*(["pattern_id"] if which else []), "path", "segments", "value"]
    _free(keep, made)
    fields = [*([_NUMBERS] if which else []), _PATH, _SEGS, _VALUE]
    if semantics == "observed":
        if array_mode != "index" or strategy == "direct":
            raise ValueError("the observed semantics know neither elementwise arrays nor look-ups")
        tests = [Observed([e]) for e in found] if which else [Observed(found)]

        def tried(document: object) -> Iterator[tuple]:
            for path, segments, at in every_path(document):
                flat = segments_of(path)
                for n, test in enumerate(tests):
                    if test.matches(flat):
                        yield (*([n] if which else []), *_told(path, segments), _clean(dump(at)))

        return _shown([*keep, *made[:-1]], _walk(df, json_col, keep, fields, tried), value)
    elementwise = array_mode == "elementwise"
    if strategy != "walk":
        if not elementwise and (literals := _literals(found)) is not None:
            return _direct(df, literals, json_col, keep, value, which)
        if strategy == "direct":
            raise ValueError("these expressions have no short list of literal paths")
    rows = _visitor(found, elementwise, which)
    return _shown([*keep, *made[:-1]], _walk(df, json_col, keep, fields, rows), value)


def _visitor(exprs: list[PathExpr], elementwise: bool, which: bool) -> Callable[[object], Iterator[tuple]]:
    automaton = Automaton(exprs)

    def visit(document: object) -> Iterator[tuple]:
        for path, segments, numbers, at in matching_paths(document, automaton, elementwise):
            row = (*_told(path, segments), _clean(dump(at)))
            if which:
                for n in numbers:
                    yield (n, *row)
            else:
                yield row

    return visit


def _literals(exprs: list[PathExpr], limit: int = 64) -> list[tuple[tuple[str, ...], list[int]]] | None:
    """Literal paths of all expressions and the numbers of those that have them; None if they are too many or infinite."""
    out: dict[tuple[str, ...], list[int]] = {}
    for number, e in enumerate(exprs):
        ways = literal_paths(e, limit)
        if ways is None:
            return None
        for w in ways:
            out.setdefault(w, []).append(number)
    total = sum(len(variant_paths(list(w)) or [None] * (limit + 1)) for w in out)
    return list(out.items()) if total <= limit else None


def _direct(df: DataFrame, literals, json_col: str, keep: list[str], value: str, which: bool) -> DataFrame:
    """Look-ups of whole paths. Nothing filters before: where nothing is found, or nothing parsed, no row is made."""
    inner = [f"k{i}" for i in range(len(keep))]
    base = df.select(*(_c(c).alias(n) for n, c in zip(inner, keep)), parsed(_c(json_col)).alias("v"))
    found = []
    for segments, numbers in literals:
        for p in variant_paths(list(segments)) or ():
            shown, rest = "$", p[1:]
            for s in segments:  # the reading of each segment: a key in quotes or an index
                cut = len(s) + 2 if rest.startswith(f"[{s}]") else len(s) + 4
                shown += f"[{s}]" if cut == len(s) + 2 else f".{s}"
                rest = rest[cut:]
            for n in numbers if which else numbers[:1]:
                row = [F.lit(n).alias("pattern_id"), F.lit(shown).alias("path"), F.array(*map(F.lit, segments)).cast("array<string>").alias("segments"), F.try_variant_get("v", p, "variant").alias("value")]
                found.append(F.struct(*row[0 if which else 1 :]))
    if not found:
        return _nothing(df, keep, value, which)
    hits = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
    return _finished(base, hits, inner, keep, value, which)


def _finished(df: DataFrame, hits: Column, inner: list[str], keep: list[str], value: str, which: bool) -> DataFrame:
    """A row for each element of `hits`, which is no column yet: for a column Catalyst would filter by its size, below the projection
    that makes it and so by making it twice."""
    out = df.select(*inner, F.inline(hits))
    return out.withColumn("value", _value(F.col("value"), value)).toDF(*keep, *(["pattern_id"] if which else []), "path", "segments", "value")


def _nothing(df: DataFrame, keep: list[str], value: str, which: bool) -> DataFrame:
    none = [*([F.lit(0).alias("pattern_id")] if which else []), F.lit("").alias("path"), F.array().cast("array<string>").alias("segments"), _value(F.parse_json(F.lit("0")), value).alias("value")]
    return df.select(*map(_c, keep), *none).where("false")


def match(df: DataFrame, exprs: Exprs, segments: Column | None = None, path: Column | None = None, matches_col: str = "matches", semantics: str = "spec") -> DataFrame:
    """`df` with a column that tells whether a path, given as segments or as text, matches one of the expressions.

    A regular expression over the encoded path, evaluated inside Spark. Where a matcher that backtracks could need
    exponential time (ambiguous repetitions, any under the observed semantics) or groups nest deep, an automaton runs over the
    different paths of Arrow batches instead. A null path gives null. ValueError if `df` has a column `matches_col`.
    """
    _one_of("semantics", semantics, SEMANTICS)
    _free(df.columns, [matches_col])
    found = _exprs(exprs)
    enc = encoded(_segments(segments, path))
    if semantics == "observed":
        try:
            regex = None if any(x.repeated for e in found for x in e.segments if isinstance(x, Group)) else observed_regex(found, 20_000)
        except ValueError:
            regex = None
        if regex is not None:
            return df.withColumn(matches_col, enc.rlike(regex))
        accepts = Observed(found).matches
    else:
        if all(Automaton([e]).plain() and depth(e) <= 100 for e in found):
            return df.withColumn(matches_col, enc.rlike("|".join(to_regex(e, possessive=True) for e in found) if found else "(?!)"))
        accepts = Automaton(found).matches

    @F.arrow_udf(T.BooleanType())
    def test(paths: pa.Array) -> pa.Array:
        return _each_once(paths, accepts, pa.bool_())

    return df.withColumn(matches_col, test(enc))


def _segments(segments: Column | None, path: Column | None) -> Column:
    if (segments is None) == (path is None):
        raise ValueError("give the paths either as segments or as text")
    return segments if segments is not None else split_path(path)


def _each_once(paths: pa.Array, f: Callable[[list[str]], object], kind: pa.DataType) -> pa.Array:
    """f of the segments of each encoded path; equal paths of a batch are looked at once."""
    known = paths.dictionary_encode()
    return pa.array([f(decode_path(p)) for p in known.dictionary.to_pylist()], kind).take(known.indices)


def match_which(df: DataFrame, patterns: DataFrame, segments: Column | None = None, path: Column | None = None, id_col: str = "pattern_id", expr_col: str = "expr") -> DataFrame:
    """Rows of `df` with the id of each pattern that their path matches, a row for every match.

    `patterns` (id, expression) is a table. Its expressions are compiled on the driver, as their language has to be parsed, to
    one automaton, which is broadcast with the ids; so the table must fit in the driver's memory. A null path matches
    nothing, a null expression is none; patterns that are there twice give a row each. ValueError if `df` has a column `id_col`.
    """
    _free(df.columns, [id_col])
    rows = [r for r in patterns.select(_c(id_col), _c(expr_col)).collect() if r[1] is not None]
    kind = patterns.schema[id_col].dataType
    ids = patterns.sparkSession.sparkContext.broadcast((Automaton([r[1] for r in rows]), [r[0] for r in rows]))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(T.ArrayType(kind))
    def which(paths: pa.Array) -> pa.Array:
        automaton, names = ids.value
        return _each_once(paths, lambda p: [names[n] for n in automaton.which(p)], pa.list_(arrow))

    return df.withColumn(id_col, F.explode(which(encoded(_segments(segments, path)))))


@lru_cache(4096)
def _split(path: str) -> tuple[str, ...]:
    return tuple(segments_of(path))


def values(df: DataFrame, path: str | Column, json_col: str = "json", keep: Sequence[str] = ("doc_id",), value: str = "json") -> DataFrame:
    """Rows (kept columns, path, value, reason), one for each row of `df`: the value at one path, or why there is none.

    path: a text such as `$.a.b[0]`, a column of such texts, or one of arrays of them, which gives a row for each element and
    reads the document once for all. reason is null for a value that was found, else one of
    "invalid document", "not found" (no such member), "out of bounds", "invalid index" (an element asked for by what is no
    integer) and "cannot navigate" (into a text, number, boolean or null), followed by the segment at which it failed. An index
    may have a sign and leading zeros. A null path has a null value and reason. ValueError for a clash with a kept column.
    """
    keep = list(keep)
    _free(keep, ["path", "value", "reason"])
    text = F.lit(path) if isinstance(path, str) else path
    several = isinstance(df.select(text).schema[0].dataType, T.ArrayType)

    def visit(json: str | None, asked: list[str | None] | None) -> Iterator[tuple]:
        document = None if json is None else load(json)
        for p in asked or ():
            if p is None or json is None:
                yield p, None, None if p is None else "invalid document"
                continue
            found, reason = look_up(document, _split(p))
            yield p, None if reason else _clean(dump(found)), reason

    fields = [_PATH, _VALUE, ("reason", T.StringType(), pa.string())]
    out = _rows_of(df, [valid_text(_c(json_col)), text if several else F.array(text)], keep, fields, visit)
    found = F.from_json("value", "variant") if value == "json" else F.parse_json("value")  # equal; parse_json is the faster
    return out.select(*map(_c, keep), "path", _value(found, value).alias("value"), "reason")


def summarise(df: DataFrame, exprs: Exprs, json_col: str = "json", keep: Sequence[str] = ("doc_id",), semantics: str = "spec", array_mode: str = "index", all_paths: bool = False) -> DataFrame:
    """Rows (kept columns, total_paths, matching_paths, matches, success[, all_paths]), one for each valid document.

    One walk a document counts and tests its paths, so nothing is grouped or shuffled. matches and all_paths are sorted.
    ValueError for an unknown option or a kept column with the name of one that is made.
    """
    _one_of("semantics", semantics, SEMANTICS)
    _one_of("array mode", array_mode, ARRAY_MODES)
    found, elementwise = _exprs(exprs), array_mode == "elementwise"
    if semantics == "observed" and elementwise:
        raise ValueError("the observed semantics do not know elementwise arrays")
    texts = (T.ArrayType(T.StringType()), pa.list_(pa.string()))
    fields = [("total_paths", T.LongType(), pa.int64()), ("matching_paths", T.LongType(), pa.int64()), ("matches", *texts), ("success", T.BooleanType(), pa.bool_()), *([("all_paths", *texts)] if all_paths else [])]
    _free(keep, [f[0] for f in fields])
    observed, automaton = Observed(found), Automaton(found)

    def visit(document: object) -> Iterator[tuple]:
        if semantics == "observed" or all_paths:
            every = [p for p, _, _ in every_path(document)]
            total = len(every)
        else:
            every, total = [], count_paths(document)
        hits = [p for p in every if observed.matches(segments_of(p))] if semantics == "observed" else [p for p, *_ in matching_paths(document, automaton, elementwise)]
        hits = sorted(map(_clean, hits))
        yield (total, len(hits), hits, bool(hits), *([sorted(map(_clean, every))] if all_paths else []))

    return _walk(df, json_col, list(keep), fields, visit)
