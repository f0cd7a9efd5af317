"""A sample of the registered queries against their SQL on the smallest tables; the rest are compared by the driver."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SOME = ["flagship", "selector_fine_grid", "agg_sum_by", "topk_by", "vv_group_left", "set_or", "fn_increase_fine", "fn_quantile_over_time", "fn_histogram_quantile", "subquery", "find_whole_traces", "topology", "otlp_exphistogram", "label_names_match", "otlp_spans", "stream_ingest", "stream_rejected", "store_spans"]


def rows(frame):
    clean = lambda v: None if v is None else "NaN" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in frame), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the benchmark tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = entry.queries()[name](spark, SF)
    wanted = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(frame.columns)
    assert columns == sorted(wanted.columns)
    found = [[v.item() if hasattr(v, "item") else v for v in r] for r in wanted[columns].itertuples(index=False)]
    assert rows(frame.select(*columns).collect()) == rows(found)


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
