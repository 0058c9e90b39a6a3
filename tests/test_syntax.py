import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom import fixtures
from pathloom.plans.syntax import Bracket, Group, PathExpr, PathSyntaxError, Property, describe, parse, tokenize

names = st.sampled_from(["a", "b", "_x9", "Child"])
brackets = st.builds(lambda t, q: Bracket(t, q), st.sampled_from(["k", "a b", "x.y", r"\"", r"\]", "é", "0"]), st.booleans()).filter(lambda b: b.quoted or '"' not in b.raw[:1])
plain = st.builds(Property, names)


def sequences(group):
    member = st.one_of(st.tuples(plain, st.lists(brackets, max_size=2)).map(lambda t: (t[0], *t[1])), group.map(lambda g: (g,)))
    return st.lists(member, min_size=1, max_size=3).map(lambda ms: tuple(n for m in ms for n in m))


groups = st.recursive(
    st.builds(lambda n, r: Group(((Property(n),),), r), names, st.booleans()),
    lambda g: st.builds(lambda ways, r: Group(tuple(ways), r), st.lists(sequences(g), min_size=1, max_size=3), st.booleans()),
    max_leaves=6,
)
exprs = st.lists(st.one_of(plain, brackets, groups), max_size=5).map(lambda ns: PathExpr(tuple(ns)))


@pytest.mark.parametrize("text, shown, count", fixtures.EXPRESSIONS)
def test_text_of_expressions(text, shown, count):
    assert parse(text).to_text() == shown
    assert describe(text)["segment_count"] == count


@given(exprs)
@settings(max_examples=300, deadline=None)
def test_expressions_read_again(expr):
    assert parse(expr.to_expr()) == expr


@pytest.mark.parametrize("text, part", fixtures.BAD_EXPRESSIONS)
def test_errors(text, part):
    with pytest.raises(PathSyntaxError, match=f"^{part} error: ") as e:
        parse(text)
    assert 0 <= e.value.position <= len(text)


@pytest.mark.parametrize("text, kinds", fixtures.TOKENS)
def test_tokens(text, kinds):
    assert [t.kind.value for t in tokenize(text)] == kinds.split()


def test_escapes_are_resolved_in_keys():
    assert parse(r'$["\"e"]').segments[0].key == '"e'
    assert parse(r"$[a\]b]").segments[0].key == "a]b"
    assert parse("$.a").segments == (Property("a"),)
    assert parse('$[ "a"]').segments == (Bracket(' "a"', False),)


@given(st.text(alphabet='$.a[]"(){}*|\\ \n', max_size=12))
@settings(max_examples=500, deadline=None)
def test_any_text_parses_or_fails_in_order(text):
    try:
        assert parse(parse(text).to_expr()) == parse(text)
    except PathSyntaxError:
        pass
