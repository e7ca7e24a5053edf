"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from strandlake.llm import decontaminate, html_text, language_id, lexical_search, license_scan, lm_score, ngram_join, packing, piece_codec, quality_rules, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_language_id": language_id.op3_language_id,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_lm_scoring": lm_score.op9_lm_scoring,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_piece_codec": piece_codec.op12_piece_codec,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op4_ngram_jaccard_join": ngram_join.OP4_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}
