"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, langid, line_dedup, ngram_join, packing, pii, shards, simhash, sketch, spelling, warc, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_bpe": bpe.op2_bpe,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_fingerprints": sketch.op6_fingerprints,
    "op7_pii": pii.op7_pii,
    "op8_warc": warc.op8_warc,
    "op9_shards": shards.op9_shards,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_simhash": simhash.op11_simhash,
    "op12_whitening": whitening.op12_whitening,
    "op13_spelling": spelling.op13_spelling,
}

SQL = {"op8_warc": warc.SQL, "op10_exact_dedup": exact_dedup.SQL}
