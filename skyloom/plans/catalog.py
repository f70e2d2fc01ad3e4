"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from skyloom.plans import q_evaluate, q_features, q_jobs, q_models, q_records, q_reshape, q_scalars, q_sequences, q_sources, q_stations, q_text  # noqa: F401
from skyloom.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
