"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from subtide.llm import ann, bpe, chat, langid, licenses, maxscore, mixing, neardup, repeats, toxicity


def queries() -> dict:
    return {
        "op1_chat": chat.op1_chat,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_bpe": bpe.op3_bpe,
        "op4_neardup": neardup.op4_neardup,
        "op5_licenses": licenses.op5_licenses,
        "op6_ann": ann.op6_ann,
        "op7_mix": mixing.op7_mix,
        "op7_mix_order": mixing.op7_mix_order,
        "op8_repeats": repeats.op8_repeats,
        "op9_maxscore": maxscore.op9_maxscore,
        "op10_langid": langid.op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained models, approximate search and byte-wise repeats are not SQL; tests hold them against brute force."""
    return {
        "op1_chat": chat.OP1_SQL,
        "op4_neardup": neardup.OP4_SQL,
        "op5_licenses": licenses.oracle(),
        "op7_mix": mixing.OP7_SQL,
        "op9_maxscore": maxscore.OP9_SQL,
    }
