"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, lines, minhash, mixing, neighbours, packing, quality, rules, secrets, spelling, tokens, warc

QUERIES = {
    "op1_token_counts": tokens.query,
    "op2_quality_classifier": quality.query,
    "op3_warc_revisits": warc.query,
    "op4_nearest_neighbours": neighbours.query,
    "op5_secret_scan": secrets.query,
    "op6_source_mixing": mixing.query,
    "op7_quality_rules": rules.query,
    "op8_minhash_near_dedup": minhash.query,
    "op9_best_fit_packing": packing.query,
    "op10_line_dedup": lines.query,
    "op11_phrase_collocations": collocations.query,
    "op12_bpe_encoding": bpe.query,
    "op13_spelling_variants": spelling.query,
}

ORACLES = {
    "op3_warc_revisits": warc.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
