"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, chat, divergence, hmm, jaccard, media, packing, pii, quality, resample, token_counts, warc

QUERIES = {
    "op1_pii": pii.query,
    "op2_media": media.query,
    "op3_ngram_jaccard_join": jaccard.query,
    "op3_ngram_jaccard_links": jaccard.links_query,
    "op4_byte_bpe": bpe.query,
    "op5_hmm_lm": hmm.query,
    "op6_chat_format": chat.query,
    "op7_token_counts": token_counts.query,
    "op8_quality": quality.query,
    "op9_packing": packing.query,
    "op10_permutation_index": ann.query,
    "op11_warc_ranges": warc.query,
    "op12_source_divergence": divergence.query,
    "op13_importance_resampling": resample.query,
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": jaccard.SQL,
    "op3_ngram_jaccard_links": jaccard.LINKS_SQL,
    "op6_chat_format": chat.SQL,
    "op11_warc_ranges": warc.SQL,
    "op12_source_divergence": divergence.SQL,
}
