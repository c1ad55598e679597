"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from slicewin.llm import decontaminate, html_text, mixing, neardup, pii, quality, rans, sharding, topk, urlfilter


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_sharding": sharding.op2_sharding,
        "op3_mixing": mixing.op3_mixing,
        "op4_topk": topk.op4_topk,
        "op5_urlfilter": urlfilter.op5_urlfilter,
        "op6_html": html_text.op6_html,
        "op7_tokens": rans.op7_tokens,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_quality": quality.op9_quality,
        "op10_neardup": neardup.op10_neardup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.ORACLE_SQL,
        "op4_topk": topk.ORACLE_SQL,
        "op5_urlfilter": urlfilter.ORACLE_SQL,
        "op8_decontamination": decontaminate.ORACLE_SQL,
        "op10_neardup": neardup.ORACLE_SQL,
    }
