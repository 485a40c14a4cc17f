"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from kinlink.llm import decontaminate, quality
from kinlink.llm.decontaminate import op5_decontaminate
from kinlink.llm.extract import op10_extract
from kinlink.llm.licenses import op8_licenses
from kinlink.llm.packing import op6_packing
from kinlink.llm.pii import op1_pii
from kinlink.llm.quality import op2_quality
from kinlink.llm.secrets import op3_secrets
from kinlink.llm.simhash import op7_simhash
from kinlink.llm.toxicity import op9_toxicity
from kinlink.llm.warc import op4_warc


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_quality": op2_quality,
        "op3_secrets": op3_secrets,
        "op4_warc": op4_warc,
        "op5_decontaminate": op5_decontaminate,
        "op6_packing": op6_packing,
        "op7_simhash": op7_simhash,
        "op8_licenses": op8_licenses,
        "op9_toxicity": op9_toxicity,
        "op10_extract": op10_extract,
    }


def oracles() -> dict[str, str]:
    return {"op2_quality": quality.ORACLE, "op5_decontaminate": decontaminate.ORACLE}
