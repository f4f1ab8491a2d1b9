"""The queries of this subpackage, by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from factloom.llm import audio, bpe, chunk_dedup, language_id, mixing, pii, quality, secret_scan, sharding, simhash

QUERIES = {
    "op1_language": language_id.op1_language,
    "op2_simhash": simhash.op2_simhash,
    "op3_sharding": sharding.op3_sharding,
    "op4_bpe": bpe.op4_bpe,
    "op5_mixing": mixing.op5_mixing,
    "op6_audio": audio.op6_audio,
    "op7_secrets": secret_scan.op7_secrets,
    "op8_substring": chunk_dedup.op8_substring,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
}

ORACLES = {
    "op3_sharding": sharding.ORACLE,
    "op5_mixing": mixing.ORACLE,
}
