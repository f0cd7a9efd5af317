"""Series and helpers of the engine's tests."""

import math

from sparkscope import api
from sparkscope.functions import labels as L
from sparkscope.plans.planner import Options

NAN = math.nan


def line(labels: dict, n: int, every: int, start: float, step: float) -> tuple[dict, list[tuple[int, float]]]:
    """n + 1 samples from time 0."""
    return labels, [(i * every, start + i * step) for i in range(n + 1)]


def points(labels: dict, every: int, values: list[float]) -> tuple[dict, list[tuple[int, float]]]:
    return labels, [(i * every, v) for i, v in enumerate(values)]


def telemetry(spark, series) -> api.Telemetry:
    rows = [(s["__name__"], sorted(s.items()), t, t * 10**9, float(v)) for s, values in series for t, v in values]
    return api.Telemetry(spark.createDataFrame(rows, f"name string, labels {L.TYPE}, ts long, ts_nano long, value double").coalesce(2))


def http_requests():
    steps = iter(range(10, 90, 10))
    return [line({"__name__": "http_requests", "job": j, "instance": i, "group": g}, 10, 300, 0, next(steps)) for j in ("api-server", "app-server") for g in ("production", "canary") for i in ("0", "1")]


def instant(data, query, at=3000, **options):
    """{labels without the name that was dropped, as sorted pairs: value} of an instant query."""
    rows = api.query_instant(data, query, at, Options(**options)).collect()
    out = {tuple((e["name"], e["value"]) for e in r["labels"]): r["value"] for r in rows}
    assert len(out) == len(rows)
    return out


def key(**labels):
    if "name" in labels:
        labels["__name__"] = labels.pop("name")
    return tuple(sorted(labels.items()))


def same(found: dict, wanted: dict) -> None:
    assert found.keys() == wanted.keys()
    for k, v in wanted.items():
        assert (math.isnan(v) and math.isnan(found[k])) or found[k] == v or abs(found[k] - v) < 1e-9 * max(1, abs(v)), (k, found[k], v)
