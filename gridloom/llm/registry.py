"""The queries of this subpackage and, where SQL can express them, the SQL they are held against."""

from __future__ import annotations

from gridloom.llm import decontaminate, neighbours, packing, pii, quality, similarity_join, substring_dedup, token_counts, token_files, url_filters

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_jaccard_join": similarity_join.op5_jaccard_join,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_token_files": token_files.op8_token_files,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
ORACLES = {"op2_substring_dedup": substring_dedup.SQL, "op4_decontaminate": decontaminate.SQL, "op5_jaccard_join": similarity_join.SQL}
