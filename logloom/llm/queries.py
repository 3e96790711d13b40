"""The ten queries, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name to the module that has it.
MODULES = {
    "op1_bpe": "bpe",
    "op2_toxicity": "toxicity",
    "op3_simhash": "simhash",
    "op4_secrets": "secrets",
    "op5_quality": "quality",
    "op6_lm": "interpolated_lm",
    "op7_licenses": "licenses",
    "op8_language": "language",
    "op9_token_files": "token_files",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict:
    def of(name: str, module: str):
        return lambda spark, sf_dir: getattr(importlib.import_module(f"logloom.llm.{module}"), name)(spark, sf_dir)

    return {name: of(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from logloom.llm import sql

    return dict(sql.ORACLES)
