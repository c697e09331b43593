"""Registered queries against their SQL twins at the smallest scale."""

import math

import duckdb
import pytest

from workload.queries import QUERIES, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "dice", "labeled_metrics", "binary_stats", "mask_union", "component_stats", "largest_component", "surface_dice", "rasterize_line", "prompt_region", "derive_endpoints", "marker_to_target",
    "select_target_instance", "keep_prompt_component", "remove_small_islands", "merge_report", "compose_organ_labels", "border_change", "refinement_boxes", "filter_available", "dedupe_records",
    "target_audit", "integrity_report", "run_summary", "memory_time", "running_means", "class_ce_dice", "plan_training_crops", "normalization_stats", "crop_zscore", "prompt_crop",
    "resample_anisotropic", "multifov_crop", "threshold_sweep", "cache_lookup", "cache_store", "run_ids", "exact_percentiles", "stream_run_status",
]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, bool) or isinstance(value, str):
        return str(value)
    try:
        return f"{float(value):.6f}"
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_twin_belongs_to_a_query():
    assert set(oracles()) <= set(QUERIES)
    assert set(QUERIES) - set(oracles()) == {"multifov_lines", "bbox_fit_lines", "aux_crop", "score_crops", "autozoom", "autozoom_trace"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(oracles()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    got = sorted(tuple(plain(row[c]) for c in order) for row in df.collect())
    assert got and got == want
