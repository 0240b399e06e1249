"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import decontaminate, html, lines, negatives, oracles, packing, pii, pipeline, quality, simhash, spelling, suffix, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1,
        "op2_suffix": suffix.op2,
        "op3_quality": quality.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_lines": lines.op5,
        "op6_topk": topk.op6,
        "op7_pii": pii.op7,
        "op8_packing": packing.op8,
        "op9_toxicity": toxicity.op9,
        "op10_warc": warc.op10,
        "op11_negatives": negatives.op11,
        "op12_html": html.op12,
        "op13_spelling": spelling.op13,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.OP4_SQL, "op5_lines": oracles.OP5_SQL, "op6_topk": topk.OP6_SQL, "op10_warc": oracles.OP10_SQL,
        "op11_negatives": negatives.OP11_SQL, "op13_spelling": oracles.OP13_SQL,
    }
