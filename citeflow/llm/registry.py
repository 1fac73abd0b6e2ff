"""Named queries of the corpus operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_MODULES = ("language_id", "exact_dedup", "mixing", "packing", "toxicity", "quality", "lm_scoring", "minhash_dedup",
            "order_minhash", "surrogates", "line_dedup", "phrase_mining", "fill_in_middle")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in _MODULES]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLE.items()}
