import math

import pytest

from sparkscope.plans.ast import Aggregate, Binary, Call, Matcher, Number, QueryError, Range, Selector, Subquery, Unary
from sparkscope.plans.parser import duration, parse, unquote
from sparkscope.plans.planner import constant


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1", 1), ("5e3", 5000), ("0xc", 12), (".5", 0.5), ("5.", 5), ("-5", -5), ("+5.5e-3", 0.0055), ("Inf", math.inf), ("+Inf", math.inf), ("-inf", -math.inf),
        ("1 + 1", 2), ("1 - 1", 0), ("1 * 1 / 0", math.inf), ("1 % 1", 0), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("1 == bool 1", 1), ("1 != bool 1", 0),
        ("- - - 1", -1), ("2 > bool 1", 1), ("1 + 2 / (3 * 1)", 1 + 2 / 3), ("-1^2", -1), ("-1*2", -2), ("-1+2", 1), ("pi()", math.pi),
    ],
)
def test_constants(text, value):
    assert constant(parse(text)) == value


def test_nan():
    assert math.isnan(constant(parse("0 / 0"))) and math.isnan(constant(parse("NaN"))) and math.isnan(constant(parse("1 % 0")))


def test_selectors():
    assert parse("foo") == Selector([Matcher("__name__", "=", "foo")])
    assert parse('foo:bar{a="bc",b!="x",c=~"y.*",d!~"z",}') == Selector([Matcher("__name__", "=", "foo:bar"), Matcher("a", "=", "bc"), Matcher("b", "!=", "x"), Matcher("c", "=~", "y.*"), Matcher("d", "!~", "z")])
    assert parse("foo offset 1h30m") == Selector([Matcher("__name__", "=", "foo")], 5400)
    assert parse("foo offset -5m").offset == -300
    assert parse("foo @ 123").at == 123 and parse("foo @ start()").at == "start"
    assert parse("foo[5m] offset 1d") == Range(Selector([Matcher("__name__", "=", "foo")], 86400), 300)
    assert parse('{__name__="foo"}') == parse("foo")
    assert isinstance(parse("foo[5m:]"), Subquery) and parse("rate(foo[5m])[1h:10m]").step == 600


def test_precedence():
    node = parse("foo + bar or bla and blub")
    assert node.op == "or" and node.left.op == "+" and node.right.op == "and"
    assert parse("a and b unless c or d").op == "or"
    assert isinstance(parse("-foo ^ 2"), Unary)
    assert parse("bar + on (foo) bla / on (baz, buz) group_right (test) blub").right.matching.include == ["test"]


def test_matching():
    m = parse("foo * on(test,blub) group_left bar").matching
    assert (m.on, m.labels, m.group) == (True, ["test", "blub"], "left")
    m = parse("foo / ignoring(test) group_left(blub) bar").matching
    assert (m.on, m.labels, m.include) == (False, ["test"], ["blub"])
    assert parse("foo == BOOL 1").returns_bool


def test_aggregates():
    a = parse("SUM BY (foo, bar) (some_metric)")
    assert a == Aggregate("sum", parse("some_metric"), None, ["foo", "bar"], False)
    assert parse("sum(some_metric) without (foo)") == parse("sum without (foo) (some_metric)")
    assert parse("topk(5, some_metric)").param == Number(5)
    assert parse('count_values("value", some_metric)').param.value == "value"


def test_calls_and_comments():
    assert parse("# comment\n 1 # more") == Number(1)
    assert isinstance(parse("rate(some_metric[5m])"), Call)
    assert isinstance(parse("round(some_metric, 5)"), Call) and isinstance(parse("hour()"), Call)
    assert isinstance(parse("a - b"), Binary)


@pytest.mark.parametrize(
    "text",
    [
        "", "1+", "(1", "1 /", "foo{", "foo{a=b}", "{}", '{x=""}', "foo bar", "sum(1)", "rate(foo)", "rate(foo[5m], 1)", "abs()", "nosuch(foo)", "foo[5m", "foo[5mm]", "foo[0m]", "foo offset bar", "1 and 1", "foo and 1",
        "1 offset 1d", "foo == bool bool 1", "foo + bool bar", "foo and on(a) group_left(b) bar", "topk(foo)", 'topk("x", foo)', 'count_values(1, foo)', "foo + on(a) group_left(a) bar", "1 + on(a) foo", 'foo{a=~"("}', "-foo[5m]", 'foo{__name__="bar"}', "\"x", "foo[5m][5m]", "sum by (a:b) (foo)", "1 @@ 2",
    ],
)
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def test_durations_and_text():
    assert duration("1w2d3h4m5s6ms") == 604800 + 2 * 86400 + 3 * 3600 + 240 + 5 + 0.006
    for bad in ("5", "1m1h", "m", "", "1s1s"):
        with pytest.raises(QueryError):
            duration(bad)
    assert unquote(r'"a\n\"b\x41é"') == 'a\n"bAé' and unquote("`a\\n`") == "a\\n"


def test_walk():
    assert [type(x).__name__ for x in parse("sum(rate(foo[5m])) / 2").walk()] == ["Binary", "Aggregate", "Call", "Range", "Selector", "Number"]
