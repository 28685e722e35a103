"""Cleaning of the documents table: five stages, each over all that the one before it kept."""

from __future__ import annotations

from cladeflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
