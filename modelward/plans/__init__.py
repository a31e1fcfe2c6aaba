"""Registered queries, one module per family."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("quality_queries", "feedback_queries", "cost_queries", "governance_queries", "model_queries", "feature_queries", "stream_queries")


def families():
    return [import_module(f"modelward.plans.{name}").R for name in _FAMILIES]
