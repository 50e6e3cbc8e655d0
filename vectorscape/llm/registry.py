"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from vectorscape.llm import bpe, chat, decontaminate, licenses, neardup, pii, quality, shards, substrings, toxicity


def queries() -> dict:
    return {
        "op1_sharding": shards.op1_sharding,
        "op2_bpe": bpe.op2_bpe,
        "op3_chat": chat.op3_chat,
        "op4_quality": quality.op4_quality,
        "op5_pii": pii.op5_pii,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_near_join": neardup.op7_near_join,
        "op8_repeats": substrings.op8_repeats,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": shards.SQL, "op3_chat": chat.SQL, "op4_quality": quality.SQL, "op7_near_join": neardup.SQL, "op9_decontaminate": decontaminate.SQL}
