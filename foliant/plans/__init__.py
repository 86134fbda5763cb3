"""Registered queries."""

from . import catalogue, queries  # noqa: F401
