import json

import pytest
from pyspark.sql import functions as F

from sparkscope import api
from sparkscope.functions import labels as L
from sparkscope.operators import catalog
from sparkscope.sources import otlp
from sparkscope.sources.store import Store
from sparkscope.streaming import ingest


def attribute(key, **value):
    return {"key": key, "value": value}


def metrics_message(*metrics, service="shop"):
    return {"resourceMetrics": [{"resource": {"attributes": [attribute("service.name", stringValue=service), attribute("host.id", stringValue="h")]}, "scopeMetrics": [{"metrics": list(metrics)}]}]}


def point(**more):
    return {"attributes": [attribute("a.b", stringValue="x"), attribute("ok", boolValue=True), attribute("n", intValue="3"), attribute("r", doubleValue=1.23), attribute("gone", stringValue=""), attribute("host.id", stringValue="own")], "timeUnixNano": "1700000000000000000", **more}


GAUGE = {"name": "cpu.usage", "unit": "1", "gauge": {"dataPoints": [point(asDouble=0.5)]}}
SUM = {"name": "http.requests_total", "unit": "1", "sum": {"dataPoints": [point(asInt="10")]}}
HISTOGRAM = {"name": "request.duration", "unit": "ms", "histogram": {"dataPoints": [point(sum=100, count="5", explicitBounds=[10, 50], bucketCounts=["1", "2", "2"])]}}
EXPONENTIAL = {"name": "payload.size", "unit": "By", "exponentialHistogram": {"dataPoints": [point(sum=3, count="3", scale=1, positive={"offset": 0, "bucketCounts": ["1", "2"]})]}}
SUMMARY = {"name": "response.time", "unit": "ms", "summary": {"dataPoints": [point(sum=9, count="2", quantileValues=[{"quantile": 0.5, "value": 40}, {"quantile": 0.9, "value": 80}])]}}


def frame(spark, message, schema):
    return spark.createDataFrame([(json.dumps(message),)], "v string").select(F.from_json("v", schema).alias("m")).select("m.*")


def read(spark, *metrics):
    rows = otlp.points(frame(spark, metrics_message(*metrics), otlp.METRICS_SCHEMA)).collect()
    return [(r["name"], {x["name"]: x["value"] for x in r["labels"]}, r["value"]) for r in rows]


def test_points(spark):
    ((name, labels, value),) = read(spark, GAUGE)
    assert (name, value) == ("cpu_usage", 0.5)
    assert labels == {"__name__": "cpu_usage", "a_b": "x", "ok": "True", "n": "3", "r": "1.23", "service_name": "shop", "host_id": "own"}
    assert [(n, v) for n, _, v in read(spark, SUM)] == [("http_requests_total", 10)]
    assert [(n, x.get("le"), v) for n, x, v in read(spark, HISTOGRAM)] == [("request_duration_milliseconds_sum", None, 100), ("request_duration_milliseconds_count", None, 5), ("request_duration_milliseconds_bucket", "10", 1), ("request_duration_milliseconds_bucket", "50", 3), ("request_duration_milliseconds_bucket", "+Inf", 5)]
    found = read(spark, EXPONENTIAL)
    assert [(n, v) for n, _, v in found] == [("payload_size_bytes_sum", 3), ("payload_size_bytes_count", 3), ("payload_size_bytes_bucket", 1), ("payload_size_bytes_bucket", 3)]
    assert found[2][1]["le"].startswith("1.414") and found[3][1]["le"] == "+Inf"
    assert [(n, x.get("quantile"), v) for n, x, v in read(spark, SUMMARY)] == [("response_time_milliseconds_sum", None, 9), ("response_time_milliseconds_count", None, 2), ("response_time_milliseconds_quantile", "0.5", 40), ("response_time_milliseconds_quantile", "0.9", 80)]


@pytest.mark.parametrize(("name", "unit", "wanted"), [("a.b", "", "a_b"), ("x_seconds", "s", "x_seconds"), ("speed", "m/s", "speed_meters_per_second"), ("n", "{thing}", "n"), ("n", "{thing}/h", "n_per_hour"), ("used", "%", "used_percent"), ("odd", "furlong", "odd_furlong")])
def test_names(spark, name, unit, wanted):
    assert spark.range(1).select(otlp.metric_name(F.lit(name), F.lit(unit))).first()[0] == wanted


def test_metadata(spark):
    rows = otlp.metric_metadata(frame(spark, metrics_message(SUM, HISTOGRAM), otlp.METRICS_SCHEMA)).collect()
    assert {(r["metric"], r["type"], r["unit"]) for r in rows} == {("http_requests", "Sum", "1"), ("request_duration_milliseconds_sum", "Histogram", "ms"), ("request_duration_milliseconds_count", "Histogram", "1"), ("request_duration_milliseconds_bucket", "Histogram", "ms")}


def spans_message(trace="00000000000000000000000000000abc", sid="00000000000000FF"):
    span = {"traceId": trace, "spanId": sid, "parentSpanId": "", "name": "op", "kind": 2, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000000005000", "attributes": [attribute("ok", boolValue=False), attribute("list", arrayValue={"values": []})], "status": {"code": 2, "message": "bad"}, "events": [{"timeUnixNano": "7", "name": "e", "attributes": []}], "links": [{"traceId": "f" * 32, "spanId": "AB"}]}
    return {"resourceSpans": [{"resource": {"attributes": [attribute("service.name", stringValue="shop")]}, "scopeSpans": [{"spans": [span]}]}]}


def test_spans(spark):
    r = otlp.spans(frame(spark, spans_message(), otlp.TRACES_SCHEMA)).first()
    assert (r["trace_id"], r["span_id"], r["duration_nanoseconds"], r["status_code"], r["status_message"]) == ("0000000000000abc", "00000000000000ff", 5000, 2, "bad")
    assert r["resource"]["service_name"] == "shop" and r["attributes"][0]["value"] == "False" and r["attributes"][1]["value_type"] == 5
    assert r["links"][0]["linked_trace_id"] == "f" * 32 and r["events"][0]["timestamp_unix_nano"] == 7


def test_stream(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    (folder / "m").mkdir(parents=True)
    (folder / "t").mkdir()
    (folder / "m/1.json").write_text(json.dumps(metrics_message(GAUGE, SUM)))
    (folder / "t/1.json").write_text(json.dumps(spans_message()))
    run = lambda n: ingest.ingest_metrics(ingest.messages(spark, str(folder / "m"), otlp.METRICS_SCHEMA), store, f"{tmp_path}/c{n}").awaitTermination()
    run(0)
    (folder / "m/2.json").write_text(json.dumps(metrics_message({**GAUGE, "unit": "s"}, HISTOGRAM)))
    run(0)
    assert store.metrics().count() == 2 + 6
    data = api.Telemetry.of_store(store)
    assert [r["value"] for r in api.query_instant(data, "cpu_usage", 1700000010).collect()] == [0.5]
    assert {r["metric"] for r in api.metadata(data).collect()} >= {"cpu_usage", "http_requests", "cpu_usage_seconds"}
    assert api.metadata(data, "http_requests_total").count() == 1
    # the same batches once more, from a checkpoint that knows nothing: nothing is doubled
    (folder / "m/2.json").rename(folder / "two.json")
    run(1)
    assert store.metrics().count() == 2 + 6 and store.metric_metadata().count() == api.Telemetry.of_store(store).metric_metadata.count()
    ingest.ingest_spans(ingest.messages(spark, str(folder / "t"), otlp.TRACES_SCHEMA), store, f"{tmp_path}/c2").awaitTermination()
    assert store.spans().count() == 1
    assert [tuple(r) for r in store.span_metadata().collect()] == [("shop", "op")]
    assert api.find_traces(api.Telemetry.of_store(store), "shop", start=1_699_999_999_000_000).count() == 1


def test_upsert(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.metrics().count() == 0 and store.metric_metadata().count() == 0
    columns = ["metric", "service_name", "type", "description", "unit"]
    for kind in ("Gauge", "Sum"):
        store.upsert_metric_metadata(spark.createDataFrame([("m", "s", kind, "d", "1")], columns))
    assert [r["type"] for r in store.metric_metadata().collect()] == ["Sum"]
    assert catalog.metric_metadata(store.metric_metadata()).first()["entries"][0]["type"] == "counter"


def test_red_stream(spark, tmp_path):
    spans = otlp.spans(frame(spark, spans_message(), otlp.TRACES_SCHEMA))
    spans.write.parquet(f"{tmp_path}/spans")
    stream = ingest.red_stream(spark.readStream.schema(spans.schema).parquet(f"{tmp_path}/spans"))
    query = stream.writeStream.format("memory").queryName("red").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["service_name"], r["requests"], r["errors"]) for r in spark.table("red").collect()] == [("shop", 1, 1)]


def test_rejected(spark):
    rows = otlp.points(frame(spark, metrics_message(GAUGE, {**GAUGE, "gauge": {"dataPoints": [point()]}}), otlp.METRICS_SCHEMA))
    assert tuple(ingest.rejected(rows, "metrics").first()) == (1, 2)
    assert rows.select(L.shown(F.col("labels"))).distinct().count() == 1


def test_rejected_rows_and_malformed_messages_are_kept(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(metrics_message(GAUGE, {**GAUGE, "gauge": {"dataPoints": [point(), {**point(asDouble=1.0), "timeUnixNano": None}]}})) + "\n{broken\n")
    for n in range(2):  # a replay doubles nothing
        ingest.ingest_metrics(ingest.messages(spark, str(folder), otlp.METRICS_SCHEMA), store, f"{tmp_path}/c{n}", pause=0).awaitTermination()
        assert store.metrics().count() == 1 and store.dead_letters().count() == 0
        assert sorted((r["reason"], r["kind"], r["batch"]) for r in store.rejected().collect()) == [("malformed", "metrics", "default-0"), ("no time", "metrics", "default-0"), ("no value", "metrics", "default-0")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/1.json").write_text(json.dumps(spans_message(sid="")))
    ingest.ingest_spans(ingest.messages(spark, str(tmp_path / "t"), otlp.TRACES_SCHEMA), store, f"{tmp_path}/t0", pause=0).awaitTermination()
    assert store.spans().count() == 0 and store.span_metadata().count() == 0
    assert [r["reason"] for r in store.rejected().where("kind = 'spans'").collect()] == ["no span id"]


def test_dead_letters(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(metrics_message(GAUGE)))
    tried, write = [], Store.write_metrics

    def failing(self, rows, batch=None):
        tried.append(batch)
        if len(tried) <= 3 or len(tried) in (5, 6):
            raise OSError("the disk is full")
        write(self, rows, batch)

    monkeypatch.setattr(Store, "write_metrics", failing)
    run = lambda c: ingest.ingest_metrics(ingest.messages(spark, str(folder), otlp.METRICS_SCHEMA), store, f"{tmp_path}/{c}", tries=3, pause=0).awaitTermination()
    run("c0")  # all three tries fail: the batch is kept, the stream goes on
    assert tried == ["default-0"] * 3 and store.metrics().count() == 0
    (letter,) = store.dead_letters().collect()
    assert "the disk is full" in letter["error"] and json.loads(letter["message"])["resourceMetrics"]
    (folder / "2.json").write_text(json.dumps(metrics_message(SUM)))
    run("c0")
    assert store.metrics().count() == 1 and store.dead_letters().count() == 1
    run("c1")  # a replay from the start: two tries fail, the third writes both messages and takes the letter back
    assert len(tried) == 7 and store.dead_letters().count() == 0
    assert store.metrics().where("batch = 'default-0'").count() == 2


def test_two_streams_on_one_store(spark, tmp_path):
    store, queries = Store(spark, f"file://{tmp_path}/store"), []
    for service in ("a", "b"):
        (tmp_path / service).mkdir()
        for n in range(3):
            (tmp_path / service / f"{n}.json").write_text(json.dumps(metrics_message({**GAUGE, "name": f"m{n}"}, {**GAUGE, "name": "1", "unit": ""}, service=service)))
        stream = ingest.messages(spark, str(tmp_path / service), otlp.METRICS_SCHEMA, files_per_batch=1)
        queries.append(ingest.ingest_metrics(stream, store, f"{tmp_path}/c-{service}", group=service, pause=0))
    for q in queries:
        q.awaitTermination()
    assert store.dead_letters().count() == 0 and store.metrics().count() == 12
    wanted = sorted((m, s) for s in "ab" for m in ("1", "m0", "m1", "m2"))
    assert sorted((r["metric"], r["service_name"]) for r in store.metric_metadata().collect()) == wanted
    store.compact("metric_metadata")
    assert sorted((r["metric"], r["service_name"]) for r in store.metric_metadata().collect()) == wanted
    assert len([p for p in (tmp_path / "store/metric_metadata").iterdir() if p.name.startswith("at=")]) == 1
    store.upsert_metric_metadata(spark.createDataFrame([("m0", "a", "Sum", "new", "1")], ["metric", "service_name", "type", "description", "unit"]))
    assert [r["description"] for r in store.metric_metadata().where("metric = 'm0' and service_name = 'a'").collect()] == ["new"]
