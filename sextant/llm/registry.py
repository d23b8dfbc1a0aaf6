"""Queries of the corpus operators, and their SQL where it can express them."""

from sextant.llm import decontamination, fingerprints, hard_negatives, html_text, language_id, licenses, merkle, mixing, near_dedup, pii, quality_rules, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_warc": warc.query,
    "op3_quality_rules": quality_rules.query,
    "op4_language_id": language_id.query,
    "op5_pii": pii.query,
    "op6_mixing": mixing.query,
    "op7_html_text": html_text.query,
    "op8_licenses": licenses.query,
    "op9_toxicity": toxicity.query,
    "op10_near_dedup": near_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_merkle": merkle.query,
    "op13_fingerprints": fingerprints.query,
}
SQL: dict[str, str] = {"op2_warc": warc.SQL, "op3_quality_rules": quality_rules.SQL, "op10_near_dedup": near_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_merkle": merkle.SQL}
