"""Column functions: validity, path splitting, values at paths, kinds, formatting."""

from __future__ import annotations

from collections.abc import Callable
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.walk import dump, load
from pathloom.plans.automaton import encode_path


def parsed(text: Column) -> Column:
    """The document as VARIANT, null if it is not valid.

    Only the first value counts, as what follows it is not read. An object with a repeated key is invalid, unless
    spark.sql.variant.allowDuplicateKeys is set: then the last one counts.
    """
    return F.try_parse_json(text)


def is_valid(text: Column) -> Column:
    """Whether a text is a JSON document; false for null and for an empty text."""
    return parsed(text).isNotNull()


def valid_text(text: Column) -> Column:
    """A text if it is a JSON document, else null. In a filter, what makes the text would be worked out once more, below it."""
    return _with(text, lambda x: F.when(is_valid(x), x))


def segments_of(path: str) -> list[str]:
    """Segments of a path such as `$.a["b c"].d[0]`; empty brackets vanish, an unclosed one is a segment of its own."""
    rest = path.removeprefix("$").removeprefix(".")
    out: list[str] = []
    while rest:
        head = rest[0]
        if head == ".":
            rest = rest[1:]
        elif head == "[" and "]" in rest:
            inner, rest = rest[1:].split("]", 1)
            if inner:
                out.append(inner[1:-1] if len(inner) > 1 and inner[0] == inner[-1] == '"' else inner)
        elif head == "[":
            out.append(head)
            rest = rest[1:]
        else:
            cut = min((i for i in (rest.find("."), rest.find("[")) if i >= 0), default=len(rest))
            out.append(rest[:cut])
            rest = rest[cut:]
    return out


_PIECE = r"""\[([^\]]*)\]|([^.\[]+)|(\[)"""


def split_path(path: Column) -> Column:
    """The same for a column, in one expression: ARRAY<STRING>; null for a null path."""
    body = F.regexp_replace(path, r"^\$?\.?", "")
    pieces = F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0))
    bare = F.transform(
        pieces,
        lambda x: F.when(x.rlike(r"^\[[^\]]*\]$"), F.regexp_replace(F.regexp_extract(x, r"^\[([^\]]*)\]$", 1), r'^"(.*)"$', "$1")).otherwise(x),
    )
    kept = F.zip_with(pieces, bare, lambda p, b: F.when(p != "[]", b))
    return F.filter(kept, lambda x: x.isNotNull())


def encoded(segments: Column) -> Column:
    """Segments as one text in which each ends with a slash: what the regular expressions of patterns run over."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.lit("/"))), "")


def array_index(segment: Column) -> Column:
    """A segment as an array index: digits only, with brackets around or not; nothing is 0, anything else or beyond INT null."""
    bare = F.when(segment.rlike(r"(?s)^\[.*\]$"), F.substring(segment, F.lit(2), F.length(segment) - 2)).otherwise(segment)
    return F.when(bare == "", F.lit(0)).when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))


def key_of(document: Column, key: str) -> Column:
    """The member of an object by its name, whatever signs that holds; null if there is none."""
    if "'" not in key:
        return F.try_variant_get(document, f"$['{key}']", "variant")
    if '"' not in key:
        return F.try_variant_get(document, f'$["{key}"]', "variant")
    return F.try_element_at(F.try_variant_get(document, "$", "map<string,variant>"), F.lit(key))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def value_at(document: Column, segments: list[str], kind: str = "variant") -> Column:
    """The value at fixed segments; a number is a key of an object or an index of an array, whichever is there.

    Null if there is none, which a JSON null is not: as VARIANT that is a value.
    """
    found = document
    for s in segments:
        if is_index(s):
            found = _with(found, _either(s))
        else:
            found = key_of(found, s)
    return found if kind == "variant" else F.try_variant_get(found, "$", kind)


def _either(s: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(key_of(x, s), F.try_variant_get(x, f"$[{s}]", "variant"))


def is_index(s: str) -> bool:
    return s.isascii() and s.isdigit() and len(s) < 11 and (s == "0" or s[0] != "0") and int(s) < 2**31


def variant_paths(segments: list[str], limit: int = 64) -> list[str] | None:
    """Variant paths of all readings of the segments; None if they are more than `limit` or a key cannot be written."""
    if sum(map(is_index, segments)) > limit.bit_length() - 1:
        return None
    out = ["$"]
    for s in segments:
        if "'" not in s:
            ways = [f"['{s}']"]
        elif '"' not in s:
            ways = [f'["{s}"]']
        else:
            return None
        if is_index(s):
            ways.append(f"[{s}]")
        out = [o + w for o in out for w in ways]
    return out


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean or null of a VARIANT."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def _indented(value: object, depth: int = 0) -> str:
    pad, end = "  " * (depth + 1), "  " * depth
    if isinstance(value, dict) and value:
        inner = ",\n".join(f"{pad}{encode_basestring(k)}: {_indented(v, depth + 1)}" for k, v in value.items())
        return f"{{\n{inner}\n{end}}}"
    if isinstance(value, list) and value:
        inner = ",\n".join(pad + _indented(v, depth + 1) for v in value)
        return f"[\n{inner}\n{end}]"
    return dump(value)


def formatted(text: str) -> str:
    """A document with an indent of two spaces; keys and numbers stay as they are."""
    return _indented(load(text))


def format_json(text: Column) -> Column:
    """The document with an indent of two spaces, numbers in Spark's spelling; null if it is not valid."""

    @F.arrow_udf(T.StringType())
    def pretty(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else formatted(t) for t in texts.to_pylist()], pa.string())

    return pretty(F.to_json(parsed(text)))


__all__ = ["array_index", "encode_path", "encoded", "format_json", "formatted", "is_valid", "kind_of", "parsed", "segments_of", "split_path", "valid_text", "value_at", "variant_paths"]
