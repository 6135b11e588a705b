"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, digest, langid, lines, mixing, phrases, quality, sharding, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vector_sharding": sharding.query,
        "op2_phrase_automata": phrases.query,
        "op3_soft_mixing": mixing.query,
        "op4_simhash_anchors": simhash.query,
        "op5_line_mph": lines.query,
        "op6_edit_decontamination": decontam.query,
        "op7_canonical_digest": digest.query,
        "op8_chat_format": chat.query,
        "op9_kneser_ney_langid": langid.query,
        "op10_site_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_phrase_automata": phrases.SQL, "op5_line_mph": lines.SQL, "op8_chat_format": chat.SQL}
