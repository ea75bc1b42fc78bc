"""What the entry module registers of this subpackage."""

from __future__ import annotations

from . import chat, mixing, packing, private, quality, repeats, sharding, simhash, token_files, vectors

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_chat_format": chat.query,
    "op3_packing": packing.query,
    "op4_simhash": simhash.query,
    "op5_sharding": sharding.query,
    "op6_private": private.query,
    "op7_mixing": mixing.query,
    "op8_repeats": repeats.query,
    "op9_quality": quality.query,
    "op10_vectors": vectors.query,
}
ORACLES = {"op2_chat_format": chat.ORACLE, "op7_mixing": mixing.ORACLE, "op9_quality": quality.ORACLE, "op10_vectors": vectors.ORACLE}
