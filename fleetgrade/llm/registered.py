"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from fleetgrade.llm import (class_lm, collocations, jaccard_join, licenses, mixing, nn_descent, pii, quality, resampling,
                            sentencepiece_bpe, toxicity, url_filters, vector_topk)

QUERIES = {
    "op1_vector_topk": vector_topk.op1_vector_topk,
    "op2_pii": pii.op2_pii,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": sentencepiece_bpe.op4_sentencepiece,
    "op5_class_lm": class_lm.op5_class_lm,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_licenses": licenses.op10_licenses,
    "op11_collocations": collocations.op11_collocations,
    "op12_resampling": resampling.op12_resampling,
    "op13_nn_descent": nn_descent.op13_nn_descent,
}
ORACLES = {
    "op1_vector_topk": vector_topk.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
