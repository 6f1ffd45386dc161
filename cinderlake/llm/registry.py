"""Queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, clustering, decontaminate, jaccard_join, line_dedup, mixing, packing, pii, quality, sharding, spelling, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_chat_format": chat.op2_chat_format,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality": quality.op5_quality,
        "op6_mixing": mixing.op6_mixing,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_warc": warc.op8_warc,
        "op9_pii": pii.op9_pii,
        "op10_topk": topk.op10_topk,
        "op11_packing": packing.op11_packing,
        "op12_spelling": spelling.op12_spelling,
        "op13_clustering": clustering.op13_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op6_mixing": mixing.ORACLE, "op8_warc": warc.ORACLE, "op10_topk": topk.ORACLE, "op13_clustering": clustering.ORACLE}
