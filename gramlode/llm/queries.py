"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import mixing, pieces, pii, quality, secrets, separators, simhash, tokenfile, toxicity, vectors

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_toxicity": toxicity.query,
    "op3_sentencepiece": pieces.query,
    "op4_token_files": tokenfile.query,
    "op5_secret_scan": secrets.query,
    "op6_simhash": simhash.query,
    "op7_token_counts": separators.query,
    "op8_pii": pii.query,
    "op9_mixing": mixing.query,
    "op10_exact_topk": vectors.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.SQL,
    "op9_mixing": mixing.SQL,
    "op10_exact_topk": vectors.SQL,
}
