"""All registered queries (importing this module fills the registry)."""

from __future__ import annotations

from askframe.plans import (catalog_answer, catalog_eval, catalog_jobs, catalog_kb, catalog_streams,  # noqa: F401
                            catalog_text, catalog_vectors)
from askframe.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
