"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from corpuslake.llm import (
    conversation_repair,
    decontamination,
    licences,
    near_dedup,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_sentence_pieces": sentence_pieces.op5_sentence_pieces,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_license_scan": licences.op9_license_scan,
        "op10_sharding": sharding.op10_sharding,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
        "quality_ablations": quality_rules.quality_ablations,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality_rules": quality_rules.OP2_SQL,
        "quality_ablations": quality_rules.ABLATIONS_SQL,
        "op3_benchmark_decontamination": decontamination.OP3_SQL,
        "op8_near_dedup": near_dedup.OP8_SQL,
        "op9_license_scan": licences.op9_sql(),
        "op10_sharding": sharding.op10_sql(),
    }
