"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "warc", "decontaminate", "toxicity", "language", "packing", "brown", "chat", "licenses", "jaccard", "manifest", "divergence", "gam")


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, where SQL can say it."""
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLES.items()}
