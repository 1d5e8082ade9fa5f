"""The queries of this subpackage and their SQL."""

from quernstone.llm import decontamination, divergence, fingerprints, jaccard_join, katz_lm, language_id, merkle, quality, sentencepiece_codec, suffix_dedup, token_counts, toxicity, url_filters

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (language_id, decontamination, toxicity, sentencepiece_codec, quality, jaccard_join, katz_lm, fingerprints, url_filters, token_counts, divergence, suffix_dedup, merkle):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
