"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from importlib import import_module

_MODULES = ("mixing", "tokens", "packing", "url_filter", "quality", "langid", "media", "simhash", "licenses", "html_extract", "alignment", "hard_negatives", "decontaminate")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"abacist.llm.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
