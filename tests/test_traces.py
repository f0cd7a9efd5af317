import pytest

from sparkscope import api
from sparkscope.operators import catalog, traces
from sparkscope.plans.ast import QueryError
from sparkscope.sources.schemas import SPAN_TYPE

S = 10**9
ATTRIBUTES = [("text", 1, "value"), ("flag", 2, "True"), ("count", 3, "31"), ("ratio", 4, "11.1")]


def span(trace, sid, service, kind, status, start, seconds, parent="", name="op", instance="", events=()):
    return (trace, sid, name, parent, start * S, (start + seconds) * S, seconds * S, status, None, kind, 1, None, (service, instance, [("zone", 1, "eu")]), ATTRIBUTES, list(events), [])


@pytest.fixture(scope="module")
def data(spark):
    rows = [
        span("t1", "s1", "web", 2, 1, 1000, 60, instance="i1"),
        span("t1", "s2", "db", 3, 2, 1010, 120, parent="s1", name="query", events=[("e", 1011 * S + 1999, [("k", 3, "5")])]),
        span("t2", "s3", "web", 2, 1, 2000, 5),
    ]
    spans = spark.createDataFrame(rows, SPAN_TYPE.get())
    return api.Telemetry(spans=spans, span_metadata=catalog.span_metadata(spans))


def ids(found):
    return {r["trace_id"]: [s["span_id"] for s in r["spans"]] for r in found.collect()}


def test_search(data):
    tags = '{"text": "value", "flag": true, "count": 31, "zone": "eu"}'
    assert ids(api.find_traces(data, "web", "op", tags, 999_000_000, 1_200_000_000, None, "60s", "120s", 10)) == {"t1": ["s1"]}
    assert ids(api.find_traces(data, tags='{"flag": false}')) == {}
    assert ids(api.find_traces(data, service=" ")) == {"t1": ["s1", "s2"], "t2": ["s3"]}
    assert ids(api.find_traces(data, limit=1)) == {"t2": ["s3"]}
    assert ids(api.find_traces(data, "db", whole_trace=True)) == {"t1": ["s1", "s2"]}
    assert ids(api.find_traces(data, lookback="10m", now=2100)) == {"t2": ["s3"]}
    assert ids(api.find_traces(data, trace_ids=["t1", "t2"])) == {"t1": ["s1", "s2"], "t2": ["s3"]}
    assert ids(api.get_trace(data, "t1", start=1_005_000_000)) == {"t1": ["s2"]}
    assert ids(api.get_trace(data, "nosuch")) == {}


def test_assembly(data):
    row = api.get_trace(data, "t1").first()
    first, second = row["spans"]
    assert (first["start_time"], first["duration"], first["process_id"], first["references"]) == (1_000_000_000, 60_000_000, "i1", [])
    assert [(t["key"], t["type"], t["value"]) for t in first["tags"]] == [("span.kind", "string", "server"), ("text", "string", "value"), ("flag", "bool", "True"), ("count", "int64", "31"), ("ratio", "float64", "11.1")]
    assert [(t["key"], t["value"]) for t in second["tags"][:2]] == [("error", "true"), ("span.kind", "client")]
    assert second["references"][0]["ref_type"] == "CHILD_OF" and second["references"][0]["span_id"] == "s1"
    assert second["logs"][0]["timestamp"] == 1_011_000_001 and second["logs"][0]["fields"][0]["value"] == "5"
    assert [(p["process_id"], p["service_name"]) for p in row["processes"]] == [("db", "db"), ("i1", "web")]


def test_catalogue(data):
    assert [r[0] for r in api.services(data).collect()] == ["db", "web"]
    assert [r[0] for r in api.operations(data, "db").collect()] == ["query"]
    edges = traces.service_edges(data.spans).collect()
    assert [(e["parent"], e["child"], e["calls"]) for e in edges] == [("web", "db", 1)]
    red = {(r["service_name"], r["requests"], r["errors"]) for r in traces.red_metrics(data.spans, "1 hour").collect()}
    assert red == {("web", 2, 0), ("db", 1, 1)}


def test_durations():
    assert [traces.nanoseconds(x) for x in ("1.5s", "2ms", "3us", "3μs", "1h", "2d", "1m")] == [1_500_000_000, 2_000_000, 3000, 3000, 3600 * S, 172800 * S, 60 * S]
    for bad in ("5", "x", "-1s"):
        with pytest.raises(QueryError):
            traces.nanoseconds(bad)
