"""A training-corpus pipeline of five operators; each stage works on all that the one before kept."""

from __future__ import annotations

from papyrine.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: No SQL: the classifier is trained, and draws and permutations use hashes that DuckDB lacks.
ORACLE_SQL = None
