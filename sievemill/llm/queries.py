"""The queries of this subpackage and the SQL that tells their rows, by name."""

from __future__ import annotations

from sievemill.llm import ann, chat, exact, html_main, minhash, negatives, packing, pieces, quality, repeats, rules, secrets, spelling

QUERIES = {
    "op1_quality_cotraining": quality.query,
    "op2_repeated_strings": repeats.query,
    "op3_secret_scan": secrets.query,
    "op4_html_main_text": html_main.query,
    "op5_minhash_near_dedup": minhash.query,
    "op6_exact_dedup": exact.query,
    "op7_sentencepiece": pieces.query,
    "op8_chat_format": chat.query,
    "op9_nearest_neighbours": ann.query,
    "op10_packing": packing.query,
    "op11_hard_negatives": negatives.query,
    "op12_spelling_variants": spelling.query,
    "op13_rule_ledger": rules.query,
}
ORACLES = {
    "op5_minhash_near_dedup": minhash.ORACLE,
    "op6_exact_dedup": exact.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_rule_ledger": rules.ORACLE,
}
