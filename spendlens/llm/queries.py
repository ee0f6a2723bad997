"""The operators' queries over whole tables, by name."""

from __future__ import annotations

from . import decontamination, language_id, near_duplicates, pieces, pii, quality_model, quality_rules, resampling, sql, substrings, suffixes, token_counts, toxicity, vector_codes
from .common import prepare


def queries() -> dict:
    found = {
        "op1_quality_model": quality_model.query,
        "op2_near_duplicates": near_duplicates.query,
        "op3_substrings": substrings.query,
        "op4_suffixes": suffixes.query,
        "op5_pii": pii.query,
        "op6_quality_rules": quality_rules.query,
        "op7_decontamination": decontamination.query,
        "op8_pieces": pieces.query,
        "op9_toxicity": toxicity.query,
        "op10_language_id": language_id.query,
        "op11_resampling": resampling.query,
        "op12_vector_codes": vector_codes.query,
        "op13_token_counts": token_counts.query,
        "pipeline": pipeline,
    }

    def ready(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        return run

    return {name: ready(fn) for name, fn in found.items()}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    """The SQL that states a query's rows; the others learn, or compare windows in ways that SQL over whole tables is too slow for: tests hold them against plain versions."""
    return {"op11_resampling": sql.resampling(), "op12_vector_codes": sql.vector_codes()}
