"""All queries of the engine by name, with the SQL each is compared to."""

from __future__ import annotations

from . import indexes, mastery, procedural, retrieval, selection, sessions, text  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "recommend_core"
