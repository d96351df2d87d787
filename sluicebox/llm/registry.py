"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import contamination, exact, html, jaccard, lines, maxent, packing, quality, secrets, suffixes

_MODULES = (contamination, exact, html, jaccard, lines, maxent, packing, quality, secrets, suffixes)


def queries() -> dict:
    found = {name: f for module in _MODULES for name, f in vars(module).items() if name.startswith("op") and name[2:3].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE", {}).items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
