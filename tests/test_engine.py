import math

import pytest
from fixtures import NAN, http_requests, instant, key, line, points, same, telemetry

from sparkscope import api
from sparkscope.plans.ast import QueryError
from sparkscope.plans.planner import Options, TooManySamples

API, APP = key(job="api-server"), key(job="app-server")


@pytest.fixture(scope="module")
def data(spark):
    return telemetry(spark, http_requests())


def values(found):
    return sorted(found.values())


GOLDEN = [
    ("SUM(http_requests) BY (job) - COUNT(http_requests) BY (job)", {API: 996, APP: 2596}),
    ("2 - SUM(http_requests) BY (job)", {API: -998, APP: -2598}),
    ("1000 / SUM(http_requests) BY (job)", {API: 1, APP: 0.38461538461538464}),
    ("SUM(http_requests) BY (job) % 3", {API: 1, APP: 2}),
    ("SUM(http_requests) BY (job) % 0.3", {API: 1000 % 0.3, APP: 2600 % 0.3}),
    ("SUM(http_requests) BY (job) ^ 2", {API: 1e6, APP: 6.76e6}),
    ("COUNT(http_requests) BY (job) ^ COUNT(http_requests) BY (job)", {API: 256, APP: 256}),
    ("SUM(http_requests) BY (job) / 0", {API: math.inf, APP: math.inf}),
    ("SUM(http_requests) BY (job) == bool 1000", {API: 1, APP: 0}),
    ('-http_requests{job="api-server",instance="0",group="production"}', {key(job="api-server", instance="0", group="production"): -100}),
    ('sum by (group) (http_requests{job="api-server"})', {key(group="canary"): 700, key(group="production"): 300}),
    ('avg(http_requests{job="api-server"}) by (group)', {key(group="canary"): 350, key(group="production"): 150}),
    ('sum without (instance) (http_requests{job="api-server"})', {key(group="canary", job="api-server"): 700, key(group="production", job="api-server"): 300}),
    ('sum by () (http_requests{job="api-server"})', {(): 1000}),
    ("sum(http_requests) by (job) + min(http_requests) by (job) + max(http_requests) by (job) + avg(http_requests) by (job)", {APP: 4550, API: 1750}),
    ('rate(http_requests{group="canary",instance="1",job="app-server"}[50m])', {key(group="canary", instance="1", job="app-server"): 0.26666666666666666}),
    ('abs(-1 * http_requests{group="production",job="api-server"})', {key(group="production", instance="0", job="api-server"): 100, key(group="production", instance="1", job="api-server"): 200}),
    ("absent(http_requests)", {}),
    ('absent(nonexistent{job="testjob",instance="testinstance",method=~".x"})', {key(job="testjob", instance="testinstance"): 1}),
    ('absent(sum(nonexistent{job="testjob"}))', {(): 1}),
    ('quantile(0.5, http_requests{job="api-server"})', {(): 250}),
    ("group(http_requests)", {(): 1}),
]


@pytest.mark.parametrize(("query", "wanted"), GOLDEN, ids=[q for q, _ in GOLDEN])
def test_golden(data, query, wanted):
    same(instant(data, query), wanted)


SETS = [
    ('http_requests{group="canary"} and http_requests{instance="0"}', [300, 700]),
    ('(http_requests{group="canary"} + 1) and on (instance, job) http_requests{instance="0",group="production"}', [301, 701]),
    ('(http_requests{group="canary"} + 1) and ignoring (group) http_requests{instance="0",group="production"}', [301, 701]),
    ('http_requests{group="canary"} or http_requests{group="production"}', [100, 200, 300, 400, 500, 600, 700, 800]),
    ('(http_requests{group="canary"} + 1) or on (instance) http_requests{instance="1"}', [301, 401, 701, 801]),
    ('http_requests{group="canary"} unless http_requests{instance="0"}', [400, 800]),
    ('http_requests{group="canary"} unless on (job) http_requests{instance="0"}', []),
    ("http_requests and on (dummy) vector(1)", [100, 200, 300, 400, 500, 600, 700, 800]),
    ("topk(3, http_requests)", [600, 700, 800]),
    ('bottomk(2, http_requests{group="canary"})', [300, 400]),
    ("topk(0, http_requests)", []),
]


@pytest.mark.parametrize(("query", "wanted"), SETS, ids=[q for q, _ in SETS])
def test_sets_and_order(data, query, wanted):
    assert values(instant(data, query)) == wanted


def test_scalars(data):
    for query, wanted in (("0 == bool 1", 0), ("1 == bool 1", 1), ("- - - 1", -1), ("1 + time() - time()", 1)):
        same(instant(data, query), {(): wanted})


def test_matching_errors(data):
    for query in ('http_requests{instance="0"} + on (job) http_requests{group="canary"}', 'http_requests{group="canary"} * on (job) group_left http_requests{instance="0"}'):
        with pytest.raises(Exception, match="duplicate series|multiple matches"):
            instant(data, query)
    with pytest.raises(Exception, match="same labelset"):
        instant(data, 'label_replace(http_requests, "instance", "", "", "") * 1 or abs(label_replace(http_requests, "instance", "", "job", ".*"))')


def test_names_that_were_all_that_differed(spark):
    data = telemetry(spark, [({"__name__": n, "a": "x"}, [(0, 1.0)]) for n in ("m1", "m2")])
    for query in ('{a="x"} * 2', 'abs({a="x"})', '-{a="x"}', 'sum_over_time({a="x"}[1m])'):
        with pytest.raises(Exception, match="same labelset"):
            instant(data, query, 0)
        assert len(api.query_instant(data, query, 0, Options(strict=False)).collect()) == 2
    assert len(instant(data, '{a="x"} > 0', 0)) == 2 and len(instant(data, "abs(m1) or abs(m2)", 0)) == 1


def test_group_labels(data):
    found = instant(data, 'http_requests{group="canary"} * on (job) group_left (tier) label_replace(sum by (job) (http_requests), "tier", "$1", "job", "(a..).*")')
    assert found[key(group="canary", instance="0", job="api-server", tier="api")] == 300 * 1000 and len(found) == 4


@pytest.fixture(scope="module")
def nans(spark):
    rows = [("production", "0", 1), ("production", "1", 2), ("canary", "0", NAN), ("canary", "1", 3), ("canary", "2", 4)]
    some = [points({"__name__": "http_requests", "group": g, "instance": i}, 300, [v]) for g, i, v in rows]
    windows = {"numbers": [2, 0, 3], "some_nan": [2, 0, NAN], "some_nan2": [2, NAN, 1], "some_nan3": [NAN, 0, 1], "only_nan": [NAN] * 3}
    return telemetry(spark, some + [points({"__name__": "data", "type": k}, 10, v) for k, v in windows.items()] + [points({"__name__": "metric"}, 10, [1, 2, 3, 4, 5])])


def test_nan_aggregates(nans):
    same(instant(nans, "max(http_requests)", 0), {(): 4})
    same(instant(nans, "min by (group) (http_requests)", 0), {key(group="production"): 1, key(group="canary"): 3})
    same(instant(nans, "sum by (group) (http_requests)", 0), {key(group="production"): 3, key(group="canary"): NAN})
    same(instant(nans, "count(http_requests)", 0), {(): 5})
    same(instant(nans, 'max(data{type="only_nan"})', 20), {(): NAN})
    assert values(instant(nans, "bottomk(2, http_requests)", 0)) == [1, 2]
    same(instant(nans, "http_requests > 1", 0), {key(name="http_requests", group="production", instance="1"): 2, key(name="http_requests", group="canary", instance="1"): 3, key(name="http_requests", group="canary", instance="2"): 4})
    same(instant(nans, 'http_requests{instance="0"} != bool 5', 0), {key(group="production", instance="0"): 1, key(group="canary", instance="0"): 1})


def test_windows_with_nan(nans):
    order = ("numbers", "some_nan", "some_nan2", "some_nan3", "only_nan")
    for f, wanted in (("min", (0, 0, 1, 0, NAN)), ("max", (3, 2, 2, 1, NAN))):
        same(instant(nans, f"{f}_over_time(data[1m])", 60), {key(type=t): v for t, v in zip(order, wanted, strict=True)})
    same(instant(nans, "avg_over_time(metric[1m])", 60), {(): 3})
    same(instant(nans, "stdvar_over_time(metric[1m])", 60), {(): 2})
    same(instant(nans, "last_over_time(metric[30s])", 60), {key(name="metric"): 5})


def test_counters(spark):
    bar = [(i * 300, i * 10.0) for i in range(6)] + [(1800 + i * 300, i * 10.0) for i in range(5)]
    data = telemetry(spark, [line({"__name__": "http_requests", "path": "/foo"}, 10, 300, 0, 10), ({"__name__": "http_requests", "path": "/bar"}, bar)])
    same(instant(data, "increase(http_requests[50m])"), {key(path="/foo"): 100, key(path="/bar"): 90})
    same(instant(data, "resets(http_requests[50m])"), {key(path="/foo"): 0, key(path="/bar"): 1})
    same(instant(data, "changes(http_requests[50m])"), {key(path="/foo"): 10, key(path="/bar"): 10})
    same(instant(data, "irate(http_requests[50m])"), {key(path="/foo"): 10 / 300, key(path="/bar"): 10 / 300})
    same(instant(data, 'deriv(http_requests{path="/foo"}[50m])'), {key(path="/foo"): 10 / 300})
    same(instant(data, 'predict_linear(http_requests{path="/foo"}[50m], 300)'), {key(path="/foo"): 110})
    same(instant(data, 'holt_winters(http_requests{path="/foo"}[50m], 0.5, 0.5)'), {key(path="/foo"): 100})


def test_grid(spark):
    data = telemetry(spark, [({"__name__": "metric"}, [(0, 1.0), (10, 2.0)])])
    run = lambda q, a, b, s, **o: [(r["step_ts"], r["value"]) for r in api.query_range(data, q, a, b, s, Options(**o)).orderBy("step_ts").collect()]
    assert run("metric", 0, 10, 5) == [(0, 1), (5, 1), (10, 2)]
    assert run("metric", 0, 2, 1) == [(0, 1), (1, 1), (2, 1)]
    assert run("1", 0, 2, "1s") == [(0, 1), (1, 1), (2, 1)]
    assert run("metric", 1, 11, 5, lookback=3) == [(1, 1), (11, 2)]
    assert run("metric offset 10s", 0, 20, 10) == [(10, 1), (20, 2)]
    assert run("metric @ 0", 0, 10, 10) == [(0, 1), (10, 1)]
    # windows are closed at both ends, whichever way they are built
    assert run("count_over_time(metric[10s])", 0, 30, 10) == [(0, 1), (10, 2), (20, 1)]
    assert run("count_over_time(metric[40s])", 0, 60, 1)[10] == (10, 2) and len(run("count_over_time(metric[40s])", 0, 60, 1)) == 51
    assert run("sum_over_time(metric[10s:5s])", 10, 10, 1) == [(10, 4)]
    assert run("absent(metric)", 0, 700, 350) == [(350, 1), (700, 1)]
    assert [(r["step_ts"], r["value"]) for r in api.query_instant(data, "metric[20s]", 10).orderBy("step_ts").collect()] == [(0, 1), (10, 2)]


def test_window_forms_agree(spark):
    values_ = [5, 7, 2, 9, NAN, 4, 4, 1, 8, 8]
    data = telemetry(spark, [points({"__name__": "m", "a": a}, 7, values_[i:]) for i, a in enumerate("xyz")])
    for f in ("rate", "increase", "delta", "irate", "idelta", "changes", "resets", "deriv", "avg_over_time", "max_over_time", "stddev_over_time", "count_over_time", "last_over_time", "present_over_time"):
        fine = {(r["step_ts"], str(r["labels"])): r["value"] for r in api.query_range(data, f"{f}(m[60s])", 0, 80, 1).collect()}
        coarse = {(r["step_ts"], str(r["labels"])): r["value"] for r in api.query_range(data, f"{f}(m[60s])", 0, 80, 20).collect()}
        same({k: v for k, v in fine.items() if k[0] % 20 == 0}, coarse)


def _buckets(name, series):
    return [line({"__name__": name, **labels, "le": le}, 10, 300, 0, step) for labels, pairs in series for le, step in pairs]


def test_histogram(spark):
    series = [({"start": "positive"}, [(".1", 5), (".2", 7), ("1e0", 11), ("+Inf", 12)]), ({"start": "negative"}, [("-.2", 1), ("-0.1", 2), ("0.3", 2), ("+Inf", 3)])]
    mixed = [({"job": "a"}, [("0.2", 1), ("2e-1", 1), ("2.0e-1", 1), ("1", 4), ("+inf", 4)]), ({"job": "b"}, [("1", 1), ("2", 2)]), ({"job": "c"}, [("+Inf", 1)])]
    data = telemetry(spark, _buckets("h", series) + _buckets("m", mixed))
    p, n = key(start="positive"), key(start="negative")
    same(instant(data, "histogram_quantile(-0.1, h)"), {p: -math.inf, n: -math.inf})
    same(instant(data, "histogram_quantile(1.01, h)"), {p: math.inf, n: math.inf})
    same(instant(data, 'histogram_quantile(0, h{start="positive"})'), {p: 0})
    same(instant(data, "histogram_quantile(0.5, h)"), {p: 0.15, n: -0.15})
    same(instant(data, "histogram_quantile(0.95, h)"), {p: 1, n: 0.3})
    same(instant(data, "histogram_quantile(0.5, m)"), {key(job="a"): 0.2 * 2 / 3, key(job="b"): NAN, key(job="c"): NAN})


def test_matchers(spark):
    one = lambda n, v, **labels: ({"__name__": n, **labels}, [(0, v)])
    data = telemetry(spark, [one("r", 1.0, route="/api", method="GET"), one("r", 2.0, route="/api", method="POST"), one("cpu", 120.5, instance="server1", job="database"), one("cpu", 95.3, instance="server2", job="webserver"), one("d", 300, op="read"), one("d", 450, op="write")])
    for query, wanted in (
        ('r{method="GET"}', [1]), ('r{method!="POST"}', [1]), ('cpu{job=~"data.*"}', [120.5]), ('d{op!~"read.*"}', [450]), ('r{nosuch="x"}', []), ('r{nosuch=""}', [1, 2]), ('cpu{job=~"data"}', []), ('r{method=~"GET|PUT"}', [1]), ('{__name__=~"c.*"}', [95.3, 120.5]), ('r{method!=""}', [1, 2]),
    ):
        assert values(instant(data, query, 0)) == wanted, query
    assert [r[0] for r in api.labels(data, ["r"]).collect()] == ["__name__", "method", "route"]
    assert [r[0] for r in api.label_values(data, "route").collect()] == ["/api"]
    assert api.series(data, ["r", 'r{method="GET"}']).count() == 2
    with pytest.raises(ValueError):
        api.label_values(data, "a-b")


def test_answers(data):
    found = api.answer(data, 'sum by (job) (http_requests) / scalar(vector(0))', at=3000)
    assert found["data"]["resultType"] == "vector" and found["data"]["result"][0] == {"metric": {"job": "api-server"}, "value": [3000, "+Inf"]}
    assert api.answer(data, "1", at=5)["data"] == {"resultType": "scalar", "result": [5, "1"]}
    assert api.answer(data, '"x"', at=5)["data"]["result"] == [5, "x"]
    matrix = api.answer(data, "sum(http_requests)", start=0, end=600, step="300s")["data"]
    assert matrix == {"resultType": "matrix", "result": [{"metric": {}, "values": [[0, "0"], [300, "360"], [600, "720"]]}]}
    assert api.answer(data, "1 +", at=0)["errorType"] == "bad_data"
    assert "resolution" in api.answer(data, "1", start=0, end=11001, step=1)["error"]
    with pytest.raises(TooManySamples):
        instant(data, "http_requests", max_samples=3)
    with pytest.raises(QueryError):
        api.query_range(data, "http_requests[5m]", 0, 10, 5)
    assert api.query_instant(data, "http_requests", 3000, limit=2).count() == 2
    assert (api.api_duration("15s"), api.api_duration("1.5"), api.api_duration("2m")) == (15, 1.5, 120)


def test_maths(spark):
    data = telemetry(spark, [({"__name__": "m", "i": str(i)}, [(0, v)]) for i, v in enumerate((-1.5, 0.0, 2.5, math.inf, NAN))])
    wanted = {"ceil": (-1, 0, 3, math.inf, NAN), "floor": (-2, 0, 2, math.inf, NAN), "round": (-1, 0, 3, math.inf, NAN), "sgn": (-1, 0, 1, 1, NAN), "ln": (NAN, -math.inf, math.log(2.5), math.inf, NAN), "sqrt": (NAN, 0, math.sqrt(2.5), math.inf, NAN)}
    for f, out in wanted.items():
        same(instant(data, f"{f}(m)", 0), {key(i=str(i)): v for i, v in enumerate(out)})
    same(instant(data, "clamp(m, 0, 2)", 0), {key(i=str(i)): v for i, v in enumerate((0, 0, 2, 2, NAN))})
    same(instant(data, 'm{i="2"} % 0', 0), {key(i="2"): NAN})
    same(instant(data, 'm{i="1"} / m{i="1"}', 0), {key(i="1"): NAN})
    same(instant(data, "day_of_week()", 86400 * 3), {(): 0})
    same(instant(data, 'label_join(m{i="0"}, "j", "-", "i", "__name__")', 0), {key(name="m", i="0", j="0-m"): -1.5})


def test_empty(spark):
    data = telemetry(spark, [])
    for q in ("m", "sum(m)", "rate(m[5m])", "m and m", "m / m", "topk(1, m)", "histogram_quantile(0.5, m)"):
        assert instant(data, q) == {}


def test_windows_by_their_ends_agree_with_copies(spark, monkeypatch):
    """Functions of a window's ends: both ways over the same samples, with resets, repeats, gaps and several samples a second."""
    import random

    from sparkscope.functions import labels as L
    from sparkscope.operators import range_functions
    from sparkscope.operators.grid import Grid

    r = random.Random(5)
    rows = []
    for series in range(5):
        t, v = 0, 0.0
        for k in range(60):
            t += r.choice((0, 1, 7, 30, 400))
            v = 0.0 if r.random() < 0.1 else v + r.randint(0, 3)
            rows.append((series, t, t * 1_000_000_000 + k, v))
    samples = spark.createDataFrame(rows, "s long, ts long, ts_nano long, value double").selectExpr("'m' AS name", "s", "ts", "ts_nano", "value")
    samples = samples.withColumn("labels", L.put(L.empty(), "s", samples["s"].cast("string"))).drop("s")
    for name in range_functions.ENDS:
        found = []
        for most in (32, 1_000_000):
            monkeypatch.setattr(range_functions, "MOST_COPIES", most)
            out = range_functions.over_time(samples, name, 300, Grid(0, 4000, 5)).selectExpr("step_ts", "to_json(labels) AS l", "round(value, 9) AS v")
            found.append(sorted(map(tuple, out.collect())))
        assert found[0] == found[1] and len(found[0]) > 500, name


def test_fractions_of_a_second_raise(spark):
    from sparkscope.plans.planner import whole

    assert whole(60.0, "a step") == 60
    with pytest.raises(QueryError):
        whole(0.5, "a step")
