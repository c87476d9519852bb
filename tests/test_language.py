"""Parser, printer and analysis."""

import pytest

from stratalog.functions.types import constant
from stratalog.lang import errors as E
from stratalog.lang.ast import Clause, Const, Field, Predicate, Query, Rule, Var, Wild
from stratalog.lang.errors import UnknownName
from stratalog.lang.parser import parse
from stratalog.plans.ir import analyse

BAR = "bar(u64)"


def test_empty_program():
    p = parse("")
    assert (p.predicates, p.queries, p.rules) == ([], [], [])


def test_predicates_with_a_comment_between():
    p = parse("bar(Baz, Boom)\n// words\nbash{fizz: Buzz, a: B^f}\n")
    assert p.predicates == [
        Predicate("bar", (("arg0", Field("Baz")), ("arg1", Field("Boom"))), False),
        Predicate("bash", (("a", Field("B", "f")), ("fizz", Field("Buzz"))), True),
    ]


def test_query():
    (q,) = parse("?q: bar(x, ~K, _) & baz{a, b: ~(3 + (7)) , c: ~n::K}").queries
    assert q == Query("q", (Clause("bar", ((None, Var("x")), (None, Const("K")), (None, Wild())), False), Clause("baz", (("a", Var("a")), ("b", Const("(3 + (7))")), ("c", Const("n::K"))), True)))


def test_rule_with_stage_and_callback():
    (r,) = parse("r@2: out(~K, y) <- ~t{key: k} + my::f // end").rules
    assert r == Rule("r", Clause("out", ((None, Const("K")), (None, Var("y"))), False), (Clause("t", (("key", Var("k")),), True, True),), "my::f", 2)


def test_circumscribed_clauses():
    (q,) = parse("?circ_query: ~bar(v) & bar(v) & ~bar(v)").queries
    assert [c.circumscribed for c in q.body] == [True, False, True]


def test_any_order_and_lossless_printing():
    text = "?q: bar(x)\nr@1: bar(y) <- ~baz{b: y, a: _} & bar(~(\")\")) + f\nbaz{b: u64, a: u8^plus}\nbar(u64)\n"
    p = parse(text)
    assert parse(str(p)).rules == p.rules and parse(str(p)) == p
    assert "@1" in str(p) and "~baz" in str(p)


@pytest.mark.parametrize("text", ["bar()", "bar(u64", "?q bar(x)", "r: a(x) <- ", "1bar(u64)", "bar(u64) )", "?q: a(~(3)", "?q: a(~(\"x)"])
def test_no_program(text):
    with pytest.raises(E.ParseError):
        parse(text)


@pytest.mark.parametrize(
    "kind, text",
    [
        (E.PredicateDefinedTwice, "bar(u64)"),
        (E.QueryDefinedTwice, "?q: bar(x)\n?q: bar(y)"),
        (E.RuleDefinedTwice, "r: bar(x) <- bar(x)\nr: bar(x) <- bar(x)"),
        (E.QueryUndefinedPredicate, "?q: nope(x)"),
        (E.QueryUndefinedPredicate, "r: bar(x) <- nope(x)"),
        (E.QueryTypeMismatch, "s(String)\n?q: bar(x) & s(x)"),
        (E.ShortClause, "?q: bar(x, y)"),
        (E.ShortClause, "two(u64, u64)\n?q: two(x)"),
        (E.MatchStyle, "?q: bar{a: x}"),
        (E.MatchStyle, "n{a: u64}\n?q: n(x)"),
        (E.DoubleBind, "n{a: u64}\n?q: n{a: x, a: y}"),
        (E.UndefinedField, "n{a: u64}\n?q: n{b: x}"),
        (E.UnboundHeadField, "r: bar(_) <- bar(x)"),
        (E.HeadPredUndefined, "r: nope(x) <- bar(x)"),
        (E.HeadTypeMismatch, "s(String)\nr: s(x) <- bar(x)"),
        (E.VarNotFound, "r: bar(y) <- bar(x)"),
        (E.MissingHeadField, "n{a: u64, b: u64}\nr: n{a: x} <- bar(x)"),
        (E.NameCollision, "Bar(u64)"),
    ],
)
def test_analysis_errors(kind, text):
    with pytest.raises(kind):
        analyse(parse(f"{BAR}\n{text}"))


def test_variables_keep_the_order_written():
    ir = analyse(parse("n{a: u64, b: u64}\n?q: n{b: y, a: x}"))
    assert list(ir.queries["q"].types) == ["y", "x"]


def test_unknown_names(spark):
    from stratalog import Database

    for text in ("p(Nope)", "p(u64^nope)", "p(u64)\n?q: p(~NOPE)", "p(u64)\nr: p(x) <- p(y) + nope"):
        with pytest.raises(E.UnknownName):
            Database(spark, text)


@pytest.mark.parametrize(
    ("text", "value"),
    [("7.0 / 2.0", 3.5), ("-7 / 2", -3), ("-7 % 2", -1), ("7.5 % 2.0", 1.5), ('"10u8"', "10u8"), ('"a::b"', "a::b"), ('"say \\"x::y\\" 3i8"', 'say "x::y" 3i8'), ("10u8 + 1_000u32", 1010), ("2f64", 2.0), ("ns::TWO * 3", 6), ("(1 << 4) | 1", 17), ("std::u8::MAX", 255)],
)
def test_constants(text, value):
    got = constant(text, {"ns::TWO": 2})
    assert got == value and type(got) is type(value)


def test_constants_that_are_none():
    for text in ("unknown", "1 / 0", "1 +"):
        with pytest.raises(UnknownName):
            constant(text, {})
