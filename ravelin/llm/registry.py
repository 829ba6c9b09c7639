"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from ravelin.llm import chat_format, co_training, decontaminate, filter_audit, language_id, periodic_runs, piece_codec, pseudo_likelihood, pseudonyms, quality_trees, sketch_join, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_quality_rules": quality_trees.op1_quality_rules,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_sketch_join": sketch_join.op3_sketch_join,
        "op4_pseudonyms": pseudonyms.op4_pseudonyms,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_co_training": co_training.op6_co_training,
        "op7_sentencepiece": piece_codec.op7_sentencepiece,
        "op8_language_id": language_id.op8_language_id,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_pseudo_likelihood": pseudo_likelihood.op10_pseudo_likelihood,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_toxicity": toxicity.op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sketch_join": sketch_join.OP3_SQL,
        "op5_chat_format": chat_format.OP5_SQL,
        "op9_suffix_dedup": suffix_dedup.OP9_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_periodic_runs": periodic_runs.OP12_SQL,
    }
