"""Text report of catalogue queries: python -m corpusloom.report DIR [QUERY...]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

#: Queries of the full analysis, by stage.
STAGES = {
    "lengths": ["A2_integrity", "A3_value_sets", "A4_mixed_cells", "A5_cell_median_cv", "A6_language_baseline", "A8_direction_mean_z", "A9_script_gap", "A10_centre_difference", "D1_range_over_spread"],
    "structure": ["L15_spectrum", "T6_leading_projection", "L17_subspace_angles", "L18_angle_null", "A12_variance_budget", "L20_centroid_agreement", "A17_pair_similarity", "A18_extremal_ranking"],
    "probes": ["L22_leave_one_language_out", "L19_pca_probe", "L23_transfer_en", "L24_transfer_summary", "L26_lexical_baseline", "L27_style_slices", "L29_probe_errors"],
    "directions": ["L41_offset_check", "A27_confidence", "L6_crosstab", "L6_crosstab_margin", "L7_association", "L8_permutation_null", "L9_length_by_assigned", "L10_mode_by_language", "L11_out_of_set", "L12_scope_test", "L13_hull", "L14_hull_bootstrap"],
    "masking": ["L30_discriminative_terms", "A24_text_kept", "D7_placeholder_leak", "D8_kept_by_technique", "L33_masking_sweep", "L32_masking_ablation", "D10_registry_masking"],
    "coordinates": ["L35_two_coordinates", "D3_best_threshold", "D4_length_matched", "D5_spearman", "D6_language_spread", "D9_one_language_entries", "D11_cited_not_proved", "L38_cap_summary", "J7_furthest_pair"],
}


def banner(title: str) -> str:
    return f"\n{title}\n{'=' * len(title)}"


def render(df: DataFrame, rows: int = 40) -> str:
    """The first rows as an aligned table."""
    got = [[("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(rows).collect()]
    table = [df.columns, *got]
    widths = [max(len(r[k]) for r in table) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in table)


def main(argv: list[str]) -> None:
    from corpusloom.plans import catalog
    from corpusloom.session import build_session

    if not argv:
        sys.exit(__doc__)
    spark = build_session()
    queries = catalog.queries()
    for stage, names in STAGES.items():
        chosen = [n for n in names if not argv[1:] or n in argv[1:]]
        if chosen:
            print(banner(stage))
        for name in chosen:
            print(f"\n-- {name}\n{render(queries[name](spark, argv[0]))}")


if __name__ == "__main__":
    main(sys.argv[1:])
