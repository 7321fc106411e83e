"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from tracemill.llm import (
    ball_tree,
    decontamination,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    repeats,
    secret_scan,
    sst,
    token_counts,
    whitening,
)

#: Registered queries, by name.
QUERIES: dict[str, Callable] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_packing": packing.op3_packing,
    "op4_repeats": repeats.op4_repeats,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_sst_output": sst.op8_sst_output,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_ball_tree": ball_tree.op11_ball_tree,
    "op12_language_id": language_id.op12_language_id,
    "op13_whitening": whitening.op13_whitening,
}

#: Equivalent SQL, where SQL expresses the query fast enough on whole tables.
ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontamination.ORACLE_SQL, "op11_ball_tree": ball_tree.ORACLE_SQL}
