"""Spark pass-through: run a batch transformation incrementally over files that keep arriving."""

from .files import run_available

__all__ = ["run_available"]
