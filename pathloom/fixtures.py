"""Small inputs with known answers, shared by queries and tests."""

from __future__ import annotations

# patterns of a set, path, whether it matches under either semantics
MATCHES: list[tuple[tuple[str, ...], tuple[str, ...], bool]] = [
    (patterns, tuple(path.split(".")), expected)
    for patterns, yes, no in (
        (("$.person.title", "$.person.mail", '$.box["code"]'), "person.title person.mail box.code", "person.age other.leaf person"),
        (("$.item.(next|leaf)",), "item.next item.leaf", "item.other other.next"),
        (('$["odd-key"]', "$[bare]", '$.item["next"]'), "odd-key bare item.next", "item.other wrong"),
        (("$.item.(next|leaf).tail",), "item.next.tail item.leaf.tail", "item.next item.leaf item.other.tail item.next.wrong"),
        (
            ("$.item.(next|leaf){*}.tail",),
            "item.tail item.next.tail item.leaf.tail item.next.next.tail item.leaf.next.tail item.next.leaf.next.tail",
            "item.next item.other.tail item.next.other.tail item.next.tail.extra",
        ),
        (
            ("$.item.(next|side.next){*}.leaf",),
            "item.leaf item.next.leaf item.side.next.leaf item.next.next.leaf item.side.next.next.leaf item.next.side.next.leaf",
            "item.next item.side.leaf item.other.leaf",
        ),
    )
    for paths, expected in ((yes, True), (no, False))
    for path in paths.split()
]

# patterns, path, spec, observed: where the two semantics part
PARTINGS: list[tuple[tuple[str, ...], tuple[str, ...], bool, bool]] = [
    (("$.item.(next|leaf).tail",), ("item", "tail"), False, True),
    (("$.properties.(name|type)",), ("properties",), False, True),
    (("$.(a|b)",), (), False, True),
    (("$.(a|a.b).c",), ("a", "b", "c"), True, False),
    (("$.(a.b|a).c",), ("a", "b", "c"), True, True),
    (("$.x.(a.(b|c).d)",), ("x", "a", "d"), False, True),
    (("$.x.(a.(b|c).d)",), ("x", "a", "b", "d"), True, False),
    (("$.item", "$.item.(a|b).c"), ("item", "a"), False, True),
    (("$.item.(a|b).c", "$.item.x"), ("item", "a", "x"), False, True),
    (("$.item.c", "$.item.(a|b).c"), ("item", "a", "c"), True, False),
    (('$["\\"e"]',), ('"e',), True, False),
    (('$["\\"e"]',), ('\\"e',), False, True),
    (("$[*]",), ("*",), True, True),
    (("$[*]",), ("a",), False, False),
]

# expression, its text, number of segments
EXPRESSIONS: list[tuple[str, str, int]] = [
    ("$", "$", 0),
    ("$.item", "$.item", 1),
    ("$.item.leaf", "$.item.leaf", 2),
    ("$[property]", "$[property]", 1),
    ('$["odd-name"]', '$["odd-name"]', 1),
    ("$.item.(next|leaf)", "$.item(.next|.leaf)", 2),
    ("$.item.(next|side.next){*}", "$.item(.next|.side.next){*}", 2),
    ("$.item.(next|side.next){*}.leaf", "$.item(.next|.side.next){*}.leaf", 3),
    ('$.item.(next|side["next"]){*}.leaf', '$.item(.next|.side["next"]){*}.leaf', 3),
    ('$.box.(rows["id"]["part"]|inner.cells){*}', '$.box(.rows["id"]["part"]|.inner.cells){*}', 2),
    (" $ . a [x] ", "$.a[x]", 2),
    ("$[]", "$[]", 1),
]

# texts that are no expressions, and the part that says so
BAD_EXPRESSIONS: list[tuple[str, str]] = [
    *((e, "parser") for e in ("", "item.leaf", "$.item.(next|leaf", "$.item{*}", "$.item.()", "$.(a|)", "$(a)", "$.[a]", '$.(["a"])', "$.a{", "$.a $")),
    *((e, "lexer") for e in ('$["unterminated', "$.0", "$.a-b", '$["a" ]', "$.(a){*x", "$.a\0")),
]

# sets of patterns as printed tries
TREES: list[tuple[tuple[str, ...], str]] = [
    ((), "$ (ROOT)\n"),
    (("$",), "$ (ROOT)\n  (END)\n"),
    (("$.item.next", '$.item["leaf"]', "$.item[leaf]"), '$ (ROOT)\n  .item\n    .next\n      (END)\n    ["leaf"]\n      (END)\n    [leaf]\n      (END)\n'),
    (("$.a.(b|c.d){*}.e",), "$ (ROOT)\n  .a\n    (GROUP {*})\n      ALT0:\n        $ (ROOT)\n          .b\n            (END)\n      ALT1:\n        $ (ROOT)\n          .c\n            .d\n              (END)\n    .e\n      (END)\n"),
    (("$.(a)",), "$ (ROOT)\n  (END)\n  (GROUP)\n    ALT0:\n      $ (ROOT)\n        .a\n          (END)\n    (END)\n"),
]

# arguments of the command line, exit code and output where the input stream is the document PERSON
COMMANDS: list[tuple[str, int, str]] = [
    ("parse -j $.item.(next|side.next){*}", 0, '{"expression":"$.item.(next|side.next){*}","parsed":"$.item(.next|.side.next){*}","root":"$","segment_count":2,"segments":[".item","(.next|.side.next){*}"]}\n'),
    ("parse $.a", 0, "Parsed: $.a\nRoot: $\nSegments (1):\n  [0] .a\n"),
    ("parse -v $.a.(b)", 0, "Parsed: $.a(.b)\nRoot: $\nSegments (2):\n  [0] .a\n  [1] (.b)\nReads again as: $.a.(b)\n"),
    ("parse a", 1, ""),
    ("test -j $.person.size @-", 0, '{"expression":"$.person.size","total_paths":11,"matching_paths":1,"matches":["$.person.size"],"success":true}\n'),
    ("test $.person.none @-", 1, "0 of 11 paths match\n"),
    ("test -q $.person -f -", 0, ""),
    ("test --elementwise $.person.lines.kind @-", 0, "+ $.person.lines[0].kind\n+ $.person.lines[1].kind\n2 of 11 paths match\n"),
    ("validate @-", 0, "valid JSON\n"),
    ("validate -j [1]", 0, '{"valid":true}\n'),
    ("validate {", 1, ""),
    ("extract -j $.person.(title|size) -", 0, '{"expression":"$.person.(title|size)","file":"-","matches":2,"values":["Ann",30]}\n'),
    ("extract $.person.lines[1].text -", 0, '[1] $.person.lines[1].text: "555-0100"\n'),
    ("extract $.none -", 1, "no match\n"),
]

TOKENS: list[tuple[str, str]] = [
    ("$", "$ end"),
    ("$.item", "$ . name end"),
    ("$.(next|leaf)", "$ . ( name | name ) end"),
    ("$.(next){*}", "$ . ( name ) {*} end"),
    ('$.a["b c"][d]', "$ . name [...] [...] end"),
]

SPLITS: list[tuple[str, tuple[str, ...]]] = [
    ("$.person.title", ("person", "title")),
    ("$.people[0].title", ("people", "0", "title")),
    ("$.box.people[0].lines[1].mail", ("box", "people", "0", "lines", "1", "mail")),
    ('$.box["odd-name"].leaf', ("box", "odd-name", "leaf")),
    ("$", ()),
    ("$.title", ("title",)),
    ("$.top.replies[0].box.people[2].card", ("top", "replies", "0", "box", "people", "2", "card")),
    ("$.a[]", ("a",)),
    ("$.a[b", ("a", "[", "b")),
    ("a..b", ("a", "b")),
]

VALIDITY: list[tuple[str, bool]] = [
    ('{"title": "Ann", "size": 30}', True),
    ('[1, 2.5, "three"]', True),
    ('{"title: "Ann"}', False),
    ('{"title": "Ann",}', False),
    ("", False),
    ("nul", False),
    ("null", True),
    ("NaN", False),
    ('"text"', True),
]

PERSON = '{"person": {"title": "Ann", "size": 30, "lines": [{"kind": "mail", "text": "ann@example.org"}, {"kind": "phone", "text": "555-0100"}]}}'
PERSON_PATHS = ["$", "$.person", *(f"$.person.{k}" for k in ("title", "size", "lines")), *(f"$.person.lines[{i}]{x}" for i in (0, 1) for x in ("", ".kind", ".text"))]

# keys that a path in text form cannot tell apart
ODD = '{"a.b": 1, "": {"c": 2}, "x[0]": 3, "say \\"hi\\"": 4, "it\'s": 5, "sl/ash~": 6, "0": [7, {"1": 8}], "é": null, "a": {"b": 9}}'
