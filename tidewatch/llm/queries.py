"""Registry of the training-data queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, importance, media, near_dup, packing, secret_scan, sharding, spelling, substring_dedup, toxicity, warc

QUERIES = {
    "op1_toxicity": (toxicity.op1_toxicity, None),
    "op2_packing": (packing.op2_packing, None),
    "op3_exact_dedup": (exact_dedup.op3_exact_dedup, exact_dedup.ORACLE),
    "op4_secret_scan": (secret_scan.op4_secret_scan, secret_scan.ORACLE),
    "op5_byte_bpe": (bpe.op5_byte_bpe, None),
    "op6_media_columns": (media.op6_media_columns, None),
    "op7_warc": (warc.op7_warc, warc.ORACLE),
    "op8_substring_dedup": (substring_dedup.op8_substring_dedup, substring_dedup.ORACLE),
    "op9_ngram_jaccard": (near_dup.op9_ngram_jaccard, near_dup.ORACLE),
    "op10_sharding": (sharding.op10_sharding, None),
    "op11_spelling_variants": (spelling.op11_spelling_variants, spelling.ORACLE),
    "op12_html_extraction": (html_text.op12_html_extraction, None),
    "op13_importance_resampling": (importance.op13_importance_resampling, importance.ORACLE),
}
