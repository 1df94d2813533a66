"""Registered queries, one module per operator family."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matrix_queries", "stat_queries", "text_queries", "panel_queries", "gate_queries", "learn_queries")


def load():
    """``(queries, sql)`` after importing every query module."""
    from respmosaic.catalog.base import QUERIES, SQL

    for name in MODULES:
        import_module(f"respmosaic.catalog.{name}")
    return QUERIES, SQL
