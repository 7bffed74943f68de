"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, collocations, exact_dedup, line_dedup, main_text, minhash, mixing, packing, partenum, pii, toxicity, warc, whitening

QUERIES = {
    "op1_warc_roundtrip": warc.op1_warc_roundtrip,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_ann": ann.op5_ann,
    "op6_near_dedup": minhash.op6_near_dedup,
    "op7_main_text": main_text.op7_main_text,
    "op8_pack": packing.op8_pack,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_whitening": whitening.op11_whitening,
    "op12_ngram_join": partenum.op12_ngram_join,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {**collocations.SQL, **exact_dedup.SQL, **mixing.SQL, **warc.SQL}
