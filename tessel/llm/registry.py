"""The queries of this subpackage, by name, and their SQL."""

from . import bpe, centroids, decontaminate, divergence, html_extract, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
    "op11_centroids": centroids.op11_centroids,
    "op12_divergence": divergence.op12_divergence,
    "op13_token_files": token_files.op13_token_files,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
