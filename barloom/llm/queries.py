"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat, hmm, html, jaccard, langid, line_dedup, mixing, near_vectors, negatives, packing, phrases, pieces, tiff


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": html.op1_html,
        "op2_near_vectors": near_vectors.op2_near_vectors,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_hmm": hmm.op6_hmm,
        "op7_language_id": langid.op7_language_id,
        "op8_tiff": tiff.op8_tiff,
        "op9_packing": packing.op9_packing,
        "op10_chat": chat.op10_chat,
        "op11_phrases": phrases.op11_phrases,
        "op12_negatives": negatives.op12_negatives,
        "op13_pieces": pieces.op13_pieces,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE, "op11_phrases": phrases.ORACLE, "op12_negatives": negatives.ORACLE}
