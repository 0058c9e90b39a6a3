"""Queries over the star-schema tables, one or more for each operator, with SQL that computes the same rows another way."""

from __future__ import annotations

import contextlib
import io
import sys
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import cli, fixtures
from pathloom.functions.json import array_index, format_json, parsed, split_path, value_at
from pathloom.operators.documents import count_kinds, extract, match, match_which, paths, summarise, values, with_validity
from pathloom.operators.patterns import PatternSet
from pathloom.plans.syntax import PathSyntaxError, parse, tokenize
from pathloom.sources.files import read_document_stream, read_documents, write_results
from pathloom.streaming.queries import window_counts, write_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("json"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (o_orderkey, o_orderstatus, json): each order that has lines as a document with an array of them."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))),
            lambda x: F.struct(x["l_linenumber"].alias("n"), x["l_partkey"].alias("part"), x["l_quantity"].alias("qty")),
        ).alias("lines")
    )
    joined = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "lines")
    return joined.select("o_orderkey", "o_orderstatus", F.to_json(F.struct(order.alias("order"))).alias("json"))


def place_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (c_custkey, json): region, nation and customer as a chain of nodes, `next` and `side.next` in turn."""
    customer, nation, region = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.struct(F.col("c_name").alias("title"))
    middle = F.struct(F.col("n_name").alias("title"), F.struct(leaf.alias("next")).alias("side"))
    return joined.select("c_custkey", F.to_json(F.struct(F.struct(F.col("r_name").alias("title"), middle.alias("next")).alias("item"))).alias("json"))


def _rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _text(x: object) -> str:
    """A SQL literal."""
    if isinstance(x, bool) or x is None:
        return str(x).upper() if x is not None else "NULL"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: Sequence[tuple], names: Sequence[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({', '.join(names)})"


# --- expressions ---

_TOKENS = [(e, t) for e, t in fixtures.TOKENS]


@_query(_values(_TOKENS, ("expr", "kinds")))
def expression_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of expressions."""
    return _rows(spark, [(e, " ".join(t.kind.value if t.kind.name not in ("NAME", "KEY") else {"NAME": "name", "KEY": "[...]"}[t.kind.name] for t in tokenize(e))) for e, _ in _TOKENS], "expr string, kinds string")


@_query(_values([(e, t, n, True) for e, t, n in fixtures.EXPRESSIONS], ("expr", "parsed", "segment_count", "reads_again")))
def expression_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and segments of expressions, and whether their other text reads again to the same."""
    rows = [(e, x.to_text(), len(x.segments), parse(x.to_expr()) == x) for e, _, _ in fixtures.EXPRESSIONS for x in [parse(e)]]
    return _rows(spark, rows, "expr string, parsed string, segment_count int, reads_again boolean")


@_query(_values([(e.replace("\0", "<NUL>"), part) for e, part in fixtures.BAD_EXPRESSIONS], ("expr", "part")))
def expression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no expressions, and which part says so."""

    def part(e: str) -> str | None:
        try:
            parse(e)
        except PathSyntaxError as x:
            return x.part
        return None

    return _rows(spark, [(e.replace("\0", "<NUL>"), part(e)) for e, _ in fixtures.BAD_EXPRESSIONS], "expr string, part string")


@_query(_values([("|".join(p), t) for p, t in fixtures.TREES], ("patterns", "tree")))
def pattern_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of patterns as printed tries."""
    return _rows(spark, [("|".join(p), PatternSet(p).tree()) for p, _ in fixtures.TREES], "patterns string, tree string")


@_query(_values(fixtures.COMMANDS, ("args", "code", "output")))
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints and returns: parse, test, validate and extract with their flags."""

    def run(args: str) -> tuple[int, str]:
        before, sys.stdin = sys.stdin, io.StringIO(fixtures.PERSON)
        try:
            with contextlib.redirect_stdout(io.StringIO()) as out, contextlib.redirect_stderr(io.StringIO()):
                return cli.main(args.split(" ")), out.getvalue()
        finally:
            sys.stdin = before

    return _rows(spark, [(args, *run(args)) for args, _, _ in fixtures.COMMANDS], "args string, code int, output string")


# --- matching ---

_CASES = [(n, ".".join(s), want) for n, (_, s, want) in enumerate(fixtures.MATCHES)]


def _cases(spark: SparkSession, semantics: str) -> DataFrame:
    out = None
    for patterns in dict.fromkeys(p for p, _, _ in fixtures.MATCHES):
        part = _rows(spark, [(n, ".".join(s), list(s)) for n, (p, s, _) in enumerate(fixtures.MATCHES) if p == patterns], "n int, path string, segments array<string>")
        part = match(part, patterns, segments=F.col("segments"), semantics=semantics)
        out = part if out is None else out.union(part)
    return out.drop("segments")


@_query(_values(_CASES, ("n", "path", "matches")))
def match_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cases, as the language is defined."""
    return _cases(spark, "spec")


@_query(_values(_CASES, ("n", "path", "matches")))
def match_cases_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cases with the observed semantics."""
    return _cases(spark, "observed")


@_query(_values([(n, s, o) for n, (_, _, s, o) in enumerate(fixtures.PARTINGS)], ("n", "spec", "observed")))
def match_partings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in which the two semantics part."""
    rows = [(n, PatternSet(p).matches(s), PatternSet(p, "observed").matches(s)) for n, (p, s, _, _) in enumerate(fixtures.PARTINGS)]
    return _rows(spark, rows, "n int, spec boolean, observed boolean")


@_query(_values([(p, "|".join(s), len(s)) for p, s in fixtures.SPLITS], ("path", "segments", "n")))
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as text split into segments."""
    df = _rows(spark, [(p,) for p, _ in fixtures.SPLITS], "path string").withColumn("s", split_path(F.col("path")))
    return df.select("path", F.array_join("s", "|").alias("segments"), F.size("s").alias("n"))


_PATTERNS = ["$.order.(status|priority)", "$.order.lines", "$.(order){*}.key", "$.order.status"]
_HITS = {"$.order.status": (0, 3), "$.order.priority": (0,), "$.order.lines": (1,), "$.order.key": (2,)}


@_query(
    "SELECT o.o_orderkey, p.path, p.pattern_id FROM (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) o, ("
    + _values([(p, n) for p, ns in _HITS.items() for n in ns], ("path", "pattern_id"))
    + ") p"
)
def multi_pattern_which(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several patterns the paths of each order match, in one walk along the ways that they allow."""
    return extract(order_documents(spark, sf_dir), _PATTERNS, keep=["o_orderkey"], which=True, value="variant").select("o_orderkey", "path", "pattern_id")


@_query(
    """SELECT c.c_custkey, p.path, p.pattern_id FROM customer c, (VALUES ('$.item.title', 'titles'), ('$.item.next.title', 'titles'), ('$.item.next.side.next.title', 'titles'),
      ('$.item', 'chain'), ('$.item.next', 'chain'), ('$.item.next.side.next', 'chain')) p(path, pattern_id)"""
)
def match_which_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a table of patterns each path of each customer's document matches."""
    every = paths(place_documents(spark, sf_dir), keep=["c_custkey"])
    patterns = _rows(spark, [("titles", "$.item.(next|side.next){*}.title"), ("chain", "$.item.(next|side.next){*}"), ("none", "$.item.side"), (None, None)], "pattern_id string, expr string")
    return match_which(every, patterns, segments=F.col("segments")).select("c_custkey", "path", "pattern_id")


@_query(
    """SELECT o_orderkey, '$.order.status' AS path, '"' || o_orderstatus || '"' AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT o_orderkey, '$.order.key', o_orderkey::VARCHAR FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
)
def pattern_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of patterns that overlap: each path once."""
    return extract(order_documents(spark, sf_dir), ["$.order.status", "$.order.(status|key)", "$[order][key]"], keep=["o_orderkey"]).drop("segments")


_LONG = [
    (0, "$.(a|b){*}.a" + ".(a|b)" * 20, "a" * 30, True),
    (1, "$.(a|b){*}.a" + ".(a|b)" * 20, "b" * 30, False),
    (2, "$" + ".a" * 5000, "a" * 5000, True),
    (3, "$" + ".a" * 5000, "a" * 4999, False),
    (4, "$." + "(" * 1000 + "a" + ")" * 1000, "a", True),
    (5, "$.(a|a.a){*}.z", "a" * 4000, False),
    (6, "$.(a|a.a){*}.z", "a" * 4000 + "z", True),
    (7, "$.((a){*}){*}", "a" * 4000, True),
]


@_query(_values([(n, m) for n, _, _, m in _LONG], ("n", "matches")))
def deep_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions with exponentially many states, thousands of segments, deep groups, or ambiguous repetitions."""
    out = None
    for n, expr, path, _ in _LONG:
        one = match(_rows(spark, [(n, list(path))], "n int, segments array<string>"), expr, segments=F.col("segments")).select("n", "matches")
        out = one if out is None else out.union(one)
    return out


# --- documents ---

_TREE = "FROM events e, json_tree(e.props) t"


@_query(f"SELECT e.event_id, t.fullkey AS path, t.atom::VARCHAR AS value {_TREE} WHERE t.fullkey = '$.k'")
def events_extract_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal path."""
    return extract(_events(spark, sf_dir), "$.k", keep=["event_id"]).drop("segments")


@_query(f"SELECT e.event_id, t.fullkey AS path, t.atom::BIGINT AS value {_TREE} WHERE t.fullkey = '$.k'")
def events_walk_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a walk, with typed values."""
    return extract(_events(spark, sf_dir), "$.k", keep=["event_id"], value="bigint", strategy="walk").drop("segments")


@_query(f"SELECT e.event_id, t.fullkey AS path {_TREE}")
def events_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of every document."""
    return paths(_events(spark, sf_dir), keep=["event_id"]).drop("segments")


@_query(f"SELECT e.event_id, t.fullkey AS path {_TREE}")
def events_all_paths_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a recursive query."""
    return paths(_events(spark, sf_dir), keep=["event_id"], strategy="recursive").drop("segments")


@_query(
    f"""SELECT e.event_id, count(*) AS total_paths, count(*) FILTER (WHERE t.fullkey = '$.k') AS matching_paths,
    string_agg(t.fullkey, ',' ORDER BY t.fullkey) FILTER (WHERE t.fullkey = '$.k') AS matches, bool_or(t.fullkey = '$.k') AS success {_TREE} GROUP BY e.event_id"""
)
def events_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paths of each document match."""
    return summarise(_events(spark, sf_dir), "$.(k|none)", keep=["event_id"]).withColumn("matches", F.array_join("matches", ","))


@_query(
    """SELECT o_orderkey, p.path, CASE p.k WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey)::VARCHAR END AS value,
      CASE p.k WHEN 2 THEN 'not found: none' WHEN 3 THEN 'out of bounds: 99' WHEN 4 THEN 'invalid index: qty' WHEN 5 THEN 'cannot navigate: x' END AS reason
    FROM orders, (VALUES (0, '$.order.key'), (1, '$.order.lines'), (2, '$.order.none.x'), (3, '$.order.lines[99].n'), (4, '$.order.lines.qty'), (5, '$.order.status.x')) p(k, path)
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT -1, '$.order.key', NULL, 'invalid document'"""
)
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at a path that differs from row to row, or why there is none."""
    asked = F.array(*map(F.lit, ("$.order.key", "$.order.lines", "$.order.none.x", "$.order.lines[99].n", "$.order.lines.qty", "$.order.status.x")))
    docs = order_documents(spark, sf_dir).select("o_orderkey", "json", asked.alias("p"))
    docs = docs.union(_rows(spark, [(-1, "{", ["$.order.key"])], "o_orderkey bigint, json string, p array<string>"))
    found = values(docs, F.col("p"), keep=["o_orderkey"], value="variant")
    count = F.size(F.try_variant_get("value", "$", "array<variant>")).cast("string")
    return found.select("o_orderkey", "path", F.when(F.col("path") == "$.order.lines", count).otherwise(F.try_variant_get("value", "$", "string")).alias("value"), "reason")


@_query(
    """SELECT form, count(*) AS n, sum(x) AS total FROM (SELECT event_id AS x FROM events) e, (VALUES ('lines'), ('orc'), ('parquet'), ('whole')) f(form)
    WHERE form <> 'whole' OR x < 20 GROUP BY form"""
)
def sources_and_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read in each form, and results of extraction written in each form and read again."""
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.to_json(F.struct(F.col("event_id").alias("x"))).alias("json"))
    out = None
    for form, sink in (("lines", "json"), ("whole", "parquet"), ("parquet", "orc"), ("orc", "parquet")):
        folder = _folder(spark, form)
        if form == "whole":  # a folder and so a file for each document
            docs.where(F.col("doc_id").cast("long") < 20).withColumnRenamed("json", "value").write.partitionBy("doc_id").text(f"{folder}/docs")
        else:
            write_results(docs.select("json") if form == "lines" else docs, f"{folder}/docs", "text" if form == "lines" else form)
        found = extract(read_documents(spark, f"{folder}/docs/*/*" if form == "whole" else f"{folder}/docs", form), "$.x", value="bigint")
        write_results(found.select("value"), f"{folder}/found", sink)
        back = spark.read.format(sink).load(f"{folder}/found").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(form).alias("form"), "n", "total")
        out = back if out is None else out.union(back)
    return out


@_query("SELECT event_id, json_valid(props) AS valid FROM events")
def events_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are documents."""
    return with_validity(_events(spark, sf_dir)).select("event_id", "valid")


@_query(_values(fixtures.VALIDITY, ("json", "valid")))
def validity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known valid and invalid texts."""
    return with_validity(_rows(spark, [(j,) for j, _ in fixtures.VALIDITY], "json string"))


@_query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty FROM events")
def events_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an indent."""
    return _events(spark, sf_dir).select("event_id", format_json(F.col("json")).alias("pretty"))


@_query(
    """SELECT path, kind, n FROM (VALUES ('$', 'object', 1), ('$.order', 'object', 1), ('$.order.key', 'number', 1), ('$.order.status', 'string', 1),
      ('$.order.priority', 'string', 1), ('$.order.lines', 'array', 1)) v(path, kind, one), (SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    UNION ALL SELECT '$.order.lines[]' || p, k, n FROM (VALUES ('', 'object'), ('.n', 'number'), ('.part', 'number'), ('.qty', 'number')) v(p, k),
      (SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
)
def orders_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of all orders, indices left out, with the kinds of their values and how many there are."""
    return count_kinds(order_documents(spark, sf_dir))


@_query(
    """SELECT o_orderkey, '$.order.status' AS path, o_orderstatus AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT o_orderkey, '$.order.priority', o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
)
def orders_group_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of alternatives."""
    return extract(order_documents(spark, sf_dir), "$.order.(status|priority)", keep=["o_orderkey"], value="string").drop("segments")


_LINES = "SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"


@_query(f"SELECT l_orderkey AS o_orderkey, '$.order.lines[0].qty' AS path, l_quantity AS value FROM ({_LINES}) WHERE i = 0")
def orders_lines_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array element by its index."""
    return extract(order_documents(spark, sf_dir), "$.order.lines[0].qty", keep=["o_orderkey"], value="double").drop("segments")


@_query(f"SELECT l_orderkey AS o_orderkey, '$.order.lines[' || i || '].qty' AS path, l_quantity AS value FROM ({_LINES})")
def orders_lines_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that goes on inside every array element."""
    return extract(order_documents(spark, sf_dir), "$.order.lines.qty", keep=["o_orderkey"], value="double", array_mode="elementwise").drop("segments")


@_query("SELECT o_orderstatus AS status, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def orders_value_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of documents, aggregated."""
    rows = extract(order_documents(spark, sf_dir), "$.order.lines.qty", keep=["o_orderstatus"], value="double", array_mode="elementwise")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum("value").alias("qty"), F.count("*").alias("n"))


@_query("SELECT l_orderkey AS o_orderkey, max(i) + 1 AS lines FROM (" + _LINES + ") GROUP BY 1 HAVING max(i) >= 2")
def orders_third_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value filter after extraction: orders that have a third line, and how many lines."""
    docs = order_documents(spark, sf_dir).withColumn("v", parsed(F.col("json")))
    third = value_at(F.col("v"), ["order", "lines", "2", "n"], "int")
    return docs.where(third.isNotNull()).select("o_orderkey", F.size(value_at(F.col("v"), ["order", "lines"], "array<variant>")).cast("long").alias("lines"))


@_query(
    """WITH p AS (SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, '$.item.title' AS path, r_name AS value FROM p UNION ALL SELECT c_custkey, '$.item.next.title', n_name FROM p
    UNION ALL SELECT c_custkey, '$.item.next.side.next.title', c_name FROM p"""
)
def places_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated group over a recursive structure."""
    return extract(place_documents(spark, sf_dir), "$.item.(next|side.next){*}.title", keep=["c_custkey"], value="string").drop("segments")


@_query(
    """WITH p AS (SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, '$.item.next.title' AS path, n_name AS value FROM p UNION ALL SELECT c_custkey, '$.item.title', r_name FROM p"""
)
def places_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed semantics, under which a group may be left out."""
    return extract(place_documents(spark, sf_dir), "$.item.(next|side.next).title", keep=["c_custkey"], value="string", semantics="observed").drop("segments")


@_query(
    """SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, count(DISTINCT role) AS roles FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"""
)
def conversations_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts out of arrays of turns, beyond ASCII."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    docs = _table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("json"))
    found = extract(docs, ["$.turns.text", "$.turns.role"], keep=["conv_id"], value="string", array_mode="elementwise", which=True)
    text = F.col("pattern_id") == 0
    return found.groupBy("conv_id").agg(F.count_if(text).alias("turns"), F.sum(F.when(text, F.length("value"))).alias("chars"), F.count_distinct(F.when(~text, F.col("value"))).alias("roles"))


_ODD_ROWS = [("a|b", "9"), ("a.b", "1"), ("", '{"c":2}'), ("|c", "2"), ("x[0]", "3"), ('say "hi"', "4"), ("it's", "5"), ("sl/ash~", "6"), ("0", '[7,{"1":8}]'), ("0|0", "7"), ("0|1|1", "8"), ("é", "null")]


@_query(_values(_ODD_ROWS, ("segments", "value")))
def odd_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with dots, brackets, quotes and slashes, told apart by their segments."""
    exprs = ["$.a.b", '$["a.b"]', '$[""]', '$[""].c', '$["x[0]"]', '$["say \\"hi\\""]', "$[it's]", "$[sl/ash~]", "$[0]", "$[0][0]", "$[0][1][1]", "$[é]"]
    found = extract(_rows(spark, [(1, fixtures.ODD)], "doc_id int, json string"), exprs)
    return found.select(F.array_join("segments", "|").alias("segments"), "value")


@_query(_values([("0", 0), ("12", 12), ("[3]", 3), ("-1", None), ("a", None), ("99999999999", None), ("", 0), ("[]", 0), ("[", None)], ("segment", "i")))
def array_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments read as array indices."""
    return _rows(spark, [(s,) for s in ("0", "12", "[3]", "-1", "a", "99999999999", "", "[]", "[")], "segment string").withColumn("i", array_index(F.col("segment")))


# --- streams ---


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    stream = read_document_stream(spark, f"{sf_dir}/events*.parquet", schema)  # type: ignore[arg-type]
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("props").alias("json"))


@_query(f"SELECT e.event_id, t.fullkey AS path, t.atom::VARCHAR AS value {_TREE} WHERE t.fullkey = '$.k'")
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction over a stream, written to files once and read again."""
    rows = extract(_event_stream(spark, sf_dir), "$.(none){*}.k", keep=["event_id"]).drop("segments")
    out = _folder(spark, "extracted")
    write_stream(rows, out, f"{out}-checkpoint", once=True).awaitTermination()
    return spark.read.parquet(out)


@_query(
    """WITH w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS matches FROM events GROUP BY 1)
    SELECT s AS start, s + INTERVAL 1 HOUR AS "end", 0 AS pattern_id, matches FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in windows of event time; only windows that the watermark has closed are there."""
    counts = window_counts(_event_stream(spark, sf_dir), ["$.k"], "ts", window="1 hour", late="1 hour")
    out = _folder(spark, "counts")
    write_stream(counts, out, f"{out}-checkpoint", once=True).awaitTermination()
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["oracle_sql", "order_documents", "place_documents", "queries"]
