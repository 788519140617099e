"""Registered queries against their SQL on the smallest tables.

``python tests/oracle.py <folder>`` runs every query; here a cross-section keeps it short.
"""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "src_api_pages", "src_raster_layer", "snk_split_species", "flt_scope_both", "flt_suspicious", "w_dedup", "w_thin",
    "w_thin_best", "ag_step_funnel", "ag_label_groups", "m_auc", "m_auc_pr", "m_maxtss_roc", "m_maxtss_sweep", "m_thresholds",
    "m_boyce_v4", "m_boyce_cbi", "m_calibration_line", "m_ensemble_score", "m_mess", "m_mess_summary", "f_horn_slope",
    "f_aspect_components", "f_horn_at_points", "jn_sample_points", "jn_align_bilinear", "jn_land_mask", "jn_point_in_polygon",
    "jn_centroid_anti", "jn_accessible_area", "jn_nearest_presence", "ag_convex_hull", "jn_hull_contains", "ml_eoo",
    "w_sample_per_species", "ag_vif", "ag_area_table", "u_area_rows", "jn_repair_topography", "w_topk_importance",
]
UNDER_LIMITS = ["m_auc", "m_thresholds", "m_boyce_v4", "m_spearman", "w_sample_uniform", "m_mess", "jn_sample_points", "jn_polygon_of_cell", "flt_min_records"]


def check(spark, name):
    ok, text = oracle.compare(entry.queries()[name](spark, FOLDER), oracle.connect(FOLDER), entry.oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    check(spark, name)


@pytest.mark.parametrize("name", UNDER_LIMITS)
def test_split_paths_match_sql(spark, tight, name):
    check(spark, name)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["species", "n_records", "group"]
    assert df.count() > 0
