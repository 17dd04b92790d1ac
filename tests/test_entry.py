"""The driver's contract, and every SQL form at the smallest scale."""

import datetime
import decimal
import os

import pytest

from kinetrace.plans import corpus, events, learning, scores, signal, timeline  # noqa: F401
from kinetrace.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        return str(x)
    return x if isinstance(x, int) else str(x)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", ["hysteresis_intervals", "window_max_tail_rule", "resample_linear", "tolerance_match", "tiou_match_f1", "choose_threshold_bounded", "deviation_scores", "label_points", "review_queue", "grouped_folds", "decode_frames", "late_fusion", "stream_sessions"])
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(got.select(*[f"`{c}`" for c in order]).collect()) == key(tuple(r[i] for i in at) for r in want.fetchall())
