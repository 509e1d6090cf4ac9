"""Queries of this subpackage and, where SQL can express them, the same results as DuckDB SQL."""

from __future__ import annotations

from jumptrail.llm.centroids import OP12_SQL, op12_centroid_clustering
from jumptrail.llm.chat import OP13_SQL, op13_chat_formatting
from jumptrail.llm.decontamination import OP1_SQL, op1_decontamination
from jumptrail.llm.language import op2_language
from jumptrail.llm.lines import op7_line_dedup
from jumptrail.llm.middle import OP11_SQL, op11_fill_in_middle
from jumptrail.llm.near_duplicates import op9_near_duplicates
from jumptrail.llm.nearest import op8_nearest
from jumptrail.llm.packing import op3_best_fit_packing
from jumptrail.llm.suffixes import op4_suffix_dedup
from jumptrail.llm.toxicity import op10_toxicity
from jumptrail.llm.training_order import op6_training_order
from jumptrail.llm.url_rules import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language": op2_language,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_training_order": op6_training_order,
    "op7_line_dedup": op7_line_dedup,
    "op8_nearest": op8_nearest,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_chat_formatting": op13_chat_formatting,
}

ORACLE = {
    "op1_decontamination": OP1_SQL,
    "op5_url_filters": OP5_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
