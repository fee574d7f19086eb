"""The operators' queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import decontaminate, jaccard, language, lines, mixing, passages, quality, suffixes, tokenshards, warc

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """The query, with this package made known to Python workers that were not started from its folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        if home not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = (
        decontaminate.op1_decontaminate, warc.op2_warc, tokenshards.op3_token_shards, language.op4_language_id, suffixes.op5_suffix_dedup,
        quality.op6_quality_rules, jaccard.op7_jaccard_join, passages.op8_near_passages, lines.op9_line_dedup, mixing.op10_source_mix,
        language.language_id_pages,
    )
    return {f.__name__: shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op6_quality_rules": quality.ORACLE}
