"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import fill_middle, fingerprints, html_text, language_id, licenses, line_dedup, multi_index, packing, quality, sentencepiece_codec, simhash, spelling, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_language_id": language_id.op3_language_id,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_html_extraction": html_text.op8_html_extraction,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_nearest_neighbours": multi_index.op12_nearest_neighbours,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op4_license_scan": licenses.OP4_SQL, "op11_fill_middle": fill_middle.OP11_SQL, "op13_spelling_variants": spelling.OP13_SQL}
