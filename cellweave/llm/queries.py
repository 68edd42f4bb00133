"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import decontaminate, html_extract, packing, pii, pipeline, quality, simhash, substring_dedup, suffix_dedup, syncmers, url_filter


def queries() -> dict[str, Callable]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_packing": packing.op4_packing,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_pii": pii.op8_pii,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_syncmers": syncmers.op10_syncmers,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.OP1_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
