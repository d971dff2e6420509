"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import ann, decontaminate, html, langid, lines, neardup, packing, ppm, secrets, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": urls.op1_urls,
        "op2_neardup": neardup.op2_neardup,
        "op3_lines": lines.op3_lines,
        "op4_language": langid.op4_language,
        "op5_secrets": secrets.op5_secrets,
        "op6_main_text": html.op6_main_text,
        "op7_search": ann.op7_search,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_pack": packing.op9_pack,
        "op10_ppm": ppm.op10_ppm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_main_text": html.OP6_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
