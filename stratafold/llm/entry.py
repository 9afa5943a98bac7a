"""The registered queries of this package: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP4_SQL, op4_decontamination
from .html_text import op8_html_text
from .line_dedup import op7_line_dedup
from .mixing import OP3_SQL, op3_mixing
from .near_dup import op10_near_dedup
from .quality import op1_quality
from .sharding import op5_sharding
from .substring_dedup import op2_substring_dedup
from .token_counts import op9_token_counts
from .toxicity import op6_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_quality": op1_quality,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_mixing": op3_mixing,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_line_dedup": op7_line_dedup,
        "op8_html_text": op8_html_text,
        "op9_token_counts": op9_token_counts,
        "op10_near_dedup": op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op4_decontamination": OP4_SQL}
