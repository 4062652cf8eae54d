"""Registered queries and their oracle SQL; importing a plan module registers its queries."""

from . import extra, fields, forest, streams, tables, tracing, trees, volume  # noqa: F401
