"""The queries of this package, by name, and their SQL where it can say the same."""

from __future__ import annotations

from tallyforge.llm import bpe, licenses, mixing, pii, quality, simhash, tokenfiles, topk, toxicity, vectors

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_topk": topk.op4_topk,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_licenses": licenses.op6_licenses,
    "op7_bpe": bpe.op7_bpe,
    "op8_vectors": vectors.op8_vectors,
    "op9_pii": pii.op9_pii,
    "op10_token_files": tokenfiles.op10_token_files,
}
ORACLES: dict[str, str] = {
    "op4_topk": topk.ORACLE,
    "op6_licenses": licenses.oracle(),
    "op8_vectors": vectors.ORACLE,
}
