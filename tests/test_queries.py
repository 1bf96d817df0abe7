"""Registered queries against their SQL on the driver's tables."""

import os

import pytest

import __spark_entry__ as entry

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
NAMES = """a3_read_feature_pages a8_merge_headers b6_to_number b15_scale_mad b16_scale_rank b22_profile_signature c6_crosswalk_one_to_one c7_crosswalk_mean c10_within_radius c11_cover_from_landmarks
c13_knn c15_facility_access c17_assign_points c18_queen_adjacency d8_safe_corr d11_cramers_v d15_total_variation d17_quantile_type8 d18_outliers_mad d33_morans_i e1_quantile_bins e7_canonical_order e9_knn_overlap_curve
i1_build_cover i5_overlap_edges i7_components i9_topology_summary i12_ball_profile_missing i14_local_colour i18_local_category_probs i20_fingerprint i23_cover_grid i28_landmark_stability i37_colour_robustness
i48_threshold_grid i49_weight_sensitivity i57_pair_sample j1_table_contract j3_compare_frames j4_semantic_equivalence
a12_resolve_readout c12_directed_hausdorff c13_knn_embeddings c19_set_gap d22_ols_factor i30_distance_diagnostics i43_run_matrix i62_scenario_sweep i62_sweep_audit
f1_byte_order_sort f2_multi_key_sort c20_comembership d32_partitions_equivalent i19_check_cover j7_csv_equivalent
a5_read_geojson a7_resolve_header_tokens e13_forward_fill e13_prefix_scan c17_rings c17_ambiguous c14_knn_by_class d20_lloyd_step i24_outcome_stats i28_cover_stability i32_transition_report i32_dominance_crossings
i33_review_checks i51_by_cell i41_family_robustness i59_ball_moran i60_cross_adjacency i60_contrast_spatial j1_checked_write i47_contrasts""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, compare, name):
    compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF)


#: The other queries of the library itself, on the smallest tables.
OTHERS = sorted(n for n in entry.oracle_sql() if n not in NAMES and n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", OTHERS)
def test_matches_sql_on_small_tables(spark, compare, name):
    compare(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
