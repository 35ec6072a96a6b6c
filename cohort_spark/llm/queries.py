"""Registered queries of this subpackage and the SQL that they are held against, where SQL can say it."""

import corpus_pipeline

from . import (
    bpe, chat_format, decontamination, html_extraction, lexical_search, line_dedup, lm_scoring, ngram_join, quality_rules,
    source_divergence, suffix_dedup, token_counts, url_filter,
)

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_ngram_jaccard": ngram_join.query,
    "op3_line_dedup": line_dedup.query,
    "op4_chat_format": chat_format.query,
    "op5_bpe": bpe.query,
    "op6_html_extraction": html_extraction.query,
    "op7_quality_rules": quality_rules.query,
    "op8_token_counts": token_counts.query,
    "op9_url_filter": url_filter.query,
    "op10_lm_scoring": lm_scoring.query,
    "op11_source_divergence": source_divergence.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_lexical_search": lexical_search.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op4_chat_format": chat_format.SQL,
    "op2_ngram_jaccard": ngram_join.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_suffix_dedup": suffix_dedup.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
