"""Every registered query against its SQL in another engine, on the smallest tables."""

import math

import duckdb
import pytest

from ocspark.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
#: The rest is compared by the driver; these stand for each family.
NAMES = ["confidence_table", "arc_mixed", "arc_direct_any", "calendar_slots", "creation_counts", "o2o_rules", "ocpa_metrics", "ngd_2", "wasserstein", "ngrams_3", "permanent_threshold", "prefix_templates", "service_times", "wip_peak", "emd_gaps", "pair_supports", "traces_to_log", "csv_backfill_first_nonnull", "arc_unit_cases", "reduce_implied", "lossless_reduction", "connected_trace_duration", "neighbors_by_type", "transitive_objects", "lifecycle_classes", "participation_classes", "never_fired", "case_statistics", "multi_run_stats", "run_aggregates", "guard_attributes", "attribute_updates", "udtf_ocel_events", "model_constraints", "constraint_filters", "evaluate_logs", "coverage_scores", "coverage_details", "confidence_report", "ocpa_statistics", "ocpa_fields", "ocpa_wmape", "wasserstein_summary", "gap_fidelity", "upper_medians", "stream_monitor_response", "untyped_arcs", "violation_report", "violation_totals", "weighted_order", "prefix_joint", "stream_obligations"]


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    try:
        return None if math.isnan(float(v)) else round(float(v), 6)
    except (ValueError, TypeError):
        return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLE) == {"mined_reduction"} and set(ORACLE) <= set(QUERIES)
