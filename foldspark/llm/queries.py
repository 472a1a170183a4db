"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import direct_codes, fertility, jaccard_join, language_id, licences, media, mixing, packing, quality, sentence_spans
from .oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": language_id.op1_language,
        "op2_packing": packing.op2_packing,
        "op3_fertility": fertility.op3_fertility,
        "op4_direct_codes": direct_codes.op4_direct_codes,
        "op5_flac": media.op5_flac,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_quality": quality.op7_quality,
        "op8_licences": licences.op8_licences,
        "op9_sentence_spans": sentence_spans.op9_sentence_spans,
        "op10_mix_sources": mixing.op10_mix_sources,
    }
