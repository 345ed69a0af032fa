"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that register queries; each has QUERIES and may have ORACLES.
MODULES = ["toxicity", "media", "quality", "chat", "licenses", "bpe", "packing", "wavelet", "embeddings", "jaccard"]


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    return {k: f for m in _modules() for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLES", {}).items()}
