"""Queries of the corpus operators, by name, and their SQL where it can express them."""

from __future__ import annotations

from . import htmltext, jaccard, licenses, matroska, mixing, negatives, phrases, pii, quality, repeats, secrets, sentencepiece, tokenfiles

#: Query name -> module that holds it.
MODULES = {
    "op1_pii": pii,
    "op2_substring_dedup": repeats,
    "op3_sentencepiece": sentencepiece,
    "op4_license_scans": licenses,
    "op5_mixing": mixing,
    "op6_secret_scans": secrets,
    "op7_quality_rules": quality,
    "op8_media_columns": matroska,
    "op9_ngram_jaccard": jaccard,
    "op10_html_extraction": htmltext,
    "op11_hard_negatives": negatives,
    "op12_token_files": tokenfiles,
    "op13_phrases": phrases,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL[name] for name, module in MODULES.items() if name in getattr(module, "SQL", {})}
