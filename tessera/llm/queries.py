"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from tessera.llm import bpe, chat, exact_dedup, imatch, jaccard_join, langid, licenses, mixing, secrets, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1,
        "op2_chat_format": chat.op2,
        "op3_language_id": langid.op3,
        "op4_fingerprints": imatch.op4,
        "op5_bpe": bpe.op5,
        "op6_secrets": secrets.op6,
        "op7_exact_dedup": exact_dedup.op7,
        "op8_jaccard_join": jaccard_join.op8,
        "op9_mixing": mixing.op9,
        "op10_licenses": licenses.op10,
    }


def oracle_sql():
    return {"op2_chat_format": chat.SQL2, "op7_exact_dedup": exact_dedup.SQL7}
