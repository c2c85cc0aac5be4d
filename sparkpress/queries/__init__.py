"""Queries over the engine's operators: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from . import aggregates, conversation, detect, facts, graphs, kernels, ladders, pipeline, similarity, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "conversation", "detect", "facts", "graphs", "kernels", "ladders", "pipeline", "similarity", "text"]
