"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from mnemora.llm import decontaminate, exact_dedup, html_text, licenses, ngram_join, pieces, quality, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_license_scan": licenses.op5_license_scan,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op9_toxicity": toxicity.op9_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
}
ORACLE_SQL = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_secret_scan": secrets.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
}
