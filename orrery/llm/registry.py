"""The thirteen queries and the pipeline, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import alignment, chat, cutting, decontaminate, htmltext, linededup, lmscore, neardup, packing, pipeline, quality, sharding, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1,
        "op2_line_dedup": linededup.op2,
        "op3_decontaminate": decontaminate.op3,
        "op4_pack": packing.op4,
        "op5_quality_rules": quality.op5,
        "op6_shard": sharding.op6,
        "op7_lm_score": lmscore.op7,
        "op8_chat_format": chat.op8,
        "op9_main_text": htmltext.op9,
        "op10_near_duplicates": neardup.op10,
        "op11_align": alignment.op11,
        "op12_whiten": whitening.op12,
        "op13_cut_pack": cutting.op13,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op1_warc": warc.SQL, "op2_line_dedup": linededup.SQL, "op3_decontaminate": decontaminate.SQL, "op7_lm_score": lmscore.SQL, "op10_near_duplicates": neardup.SQL}
    return sql | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
