"""Registered queries against their SQL twins on the smallest tables (all of them: python check.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

FAST = ["classify_packet", "packet_role", "flow_id_candidates", "parse_alert_lines", "alert_drop_report", "syn_window_features",
        "endpoint_window_features", "auth_window_features", "client_window_features", "client_window_batch_22", "flow_features_11",
        "flow_prefix", "flow_confusion", "ip_confusion", "engine_confusion", "ensemble_confusion", "threshold_sweep", "gate_sweep",
        "postfilter_simulation", "lookup_label", "attach_nth_log", "cap_per_class", "stratified_split", "robust_scale", "score_trees",
        "read_headerless_flows", "read_packet_export", "load_registry", "continued_no_round", "continued_round", "leave_one_day_out_short",
        "calibrate_isotonic", "isotonic_blocks", "explain_trees", "encode_with_unknown", "publish_alerts", "auth_suppress_reason",
        "client_suppress_reason", "late_rows", "flush_idle", "bounded_history_stream", "read_score_stream_by_line", "read_flow_table_orders"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
