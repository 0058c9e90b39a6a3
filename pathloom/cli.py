"""Command line: parse, test, validate and extract, for one document at a time and without Spark; the file - is the input stream."""

from __future__ import annotations

import argparse
import json
import sys

from pathloom.functions.json import formatted, segments_of
from pathloom.operators.patterns import PatternSet
from pathloom.operators.walk import dump, every_path, load, matching_paths
from pathloom.plans.automaton import Automaton
from pathloom.plans.syntax import PathSyntaxError, describe, parse

SEPARATORS = (",", ":")


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _read(text: str) -> tuple[str, object]:
    if text == "@-":
        text = sys.stdin.read()
    elif text.startswith("@"):
        with open(text[1:], encoding="utf-8") as f:
            text = f.read()
    json.JSONDecoder(parse_constant=_no_constant).raw_decode(text.lstrip(" \t\n\r"))
    return text, load(text)


def _matches(args: argparse.Namespace, document: object) -> list[tuple[str, object]]:
    if args.observed:
        patterns = PatternSet([args.expression], "observed")
        return [(p, v) for p, _, v in every_path(document) if patterns.matches(segments_of(p))]
    return [(p, v) for p, _, _, v in matching_paths(document, Automaton([parse(args.expression)]), args.elementwise)]


def _print(args: argparse.Namespace, result: dict[str, object]) -> None:
    text = "{" + ",".join(f"{json.dumps(k)}:{v[0] if isinstance(v, tuple) else json.dumps(v, ensure_ascii=False, separators=SEPARATORS)}" for k, v in result.items()) + "}"
    print(formatted(text) if args.pretty else text)


def main(argv: list[str] | None = None) -> int:
    """Exit code 0; 1 for an invalid expression or document, an unreadable file, or no match."""
    flags = argparse.ArgumentParser(add_help=False)
    flags.add_argument("-v", "--verbose", action="store_true", help="say more")
    flags.add_argument("-q", "--quiet", action="store_true", help="say less")
    flags.add_argument("-j", "--json", action="store_true", help="print JSON and nothing else")
    flags.add_argument("-p", "--pretty", action="store_true", help="indent the JSON")
    flags.add_argument("--observed", action="store_true", help="match with the observed semantics")
    flags.add_argument("--elementwise", action="store_true", help="let patterns go on inside array elements")
    top = argparse.ArgumentParser(prog="pathloom", description="Path expressions over JSON documents.")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("parse", parents=[flags], help="show what an expression consists of").add_argument("expression")
    p = sub.add_parser("test", parents=[flags], help="test an expression on a document")
    p.add_argument("expression")
    p.add_argument("document", nargs="?", help="JSON text or @file")
    p.add_argument("-f", "--file", help="file with the document")
    sub.add_parser("validate", parents=[flags], help="check a document").add_argument("document", help="JSON text or @file")
    p = sub.add_parser("extract", parents=[flags], help="values at the paths that match")
    p.add_argument("expression")
    p.add_argument("file")
    args = top.parse_args(argv)
    try:
        return _run(args)
    except PathSyntaxError as e:
        print(f"invalid expression: {e}", file=sys.stderr)
    except OSError as e:
        print(f"cannot read: {e}", file=sys.stderr)
    except ValueError as e:
        if not args.quiet:
            print(f"invalid JSON: {e}", file=sys.stderr)
    return 1


def _run(args: argparse.Namespace) -> int:
    if args.command == "parse":
        result = describe(args.expression)
        if args.json:
            _print(args, result)
        else:
            print(f"Parsed: {result['parsed']}\nRoot: {result['root']}\nSegments ({result['segment_count']}):")
            for i, s in enumerate(result["segments"]):
                print(f"  [{i}] {s}")
            if args.verbose:
                print(f"Reads again as: {parse(args.expression).to_expr()}")
        return 0
    if args.command == "validate":
        text, _ = _read(args.document)
        if args.json:
            _print(args, {"valid": True})
        elif not args.quiet:
            print("valid JSON")
            if args.verbose:
                print(formatted(text))
        return 0
    source = f"@{args.file}" if args.file else args.document
    if source is None:
        raise OSError("no document given")
    _, document = _read(source)
    found = _matches(args, document)
    if args.command == "test":
        every = [p for p, _, _ in every_path(document)]
        hits = {p for p, _ in found}
        if args.json:
            more = {"all_paths": every} if args.verbose else {}
            _print(args, {"expression": args.expression, "total_paths": len(every), "matching_paths": len(found), "matches": [p for p, _ in found], "success": bool(found), **more})
        elif not args.quiet:
            for p in every if args.verbose else [p for p, _ in found]:
                print(f"{'+' if p in hits else '-'} {p}")
            print(f"{len(found)} of {len(every)} paths match")
        return 0 if found else 1
    if args.json:
        values = ("[" + ",".join(dump(v) for _, v in found) + "]",)
        more = {"paths": [p for p, _ in found]} if args.verbose else {}
        _print(args, {"expression": args.expression, "file": args.file, "matches": len(found), "values": values, **more})
    elif not args.quiet:
        for i, (p, v) in enumerate(found, 1):
            print(f"[{i}] {p}: {dump(v)}")
        if not found:
            print("no match")
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(main())
