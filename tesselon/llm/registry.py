"""The queries of this package and their SQL, by name. Modules are imported when
a query is called, except for their SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query -> (module, whether the module's ORACLE holds SQL for it)
_QUERIES = {
    "op1_decontaminate": ("decontaminate", True),
    "op2_topk_search": ("topk_search", True),
    "op3_ngram_lm": ("ngram_lm", False),
    "op4_html_text": ("html_text", False),
    "op5_chat_format": ("chat_format", True),
    "op6_secret_scan": ("secret_scan", False),
    "op7_toxicity": ("toxicity", False),
    "op8_pieces": ("pieces", False),
    "op9_near_dup": ("near_dup", True),
    "op10_lang_id": ("lang_id", False),
    "op11_importance_resample": ("importance", True),
    "op12_quality": ("quality", False),
}


def _run(module: str, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return getattr(importlib.import_module(f"tesselon.llm.{module}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: functools.partial(_run, module, name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"tesselon.llm.{module}").ORACLE for name, (module, sql) in _QUERIES.items() if sql}
