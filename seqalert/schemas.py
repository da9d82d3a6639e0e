"""Schemas of files and records, as DDL."""

SCORE_RECORD = """
    file string, dataset string, syscall_mapping_source string, syscall_mapping_ref string, syscall_abi string,
    window_size int, stride int, first_window bigint, raw_tokens bigint, mapped_tokens bigint, compat_num_remap bigint,
    name_from_num_remap bigint, oov_to_zero bigint, oov_rate double, unknown_name_count bigint,
    unknown_name_examples array<string>, n_windows bigint, phase5_tau double,
    selected_paths struct<path_a: string, path_b: string, path_c: string>, status string,
    path_a_scores array<double>, path_b_scores array<double>, path_c_scores array<double>,
    phase5_probs array<double>, phase5_positive array<boolean>
"""
MANIFEST = """
    schema_version int, entries array<struct<sample_id: string, intended_label: string, target_preset: string,
    source_group: string, source_file: string, expected_detect_file: string, expected_converted_file: string>>
"""
TOKENS = "trace_id string, pos bigint, token int"
EPISODE_SEGMENTS = "array<struct<label string, start_window bigint, end_window bigint>>"
