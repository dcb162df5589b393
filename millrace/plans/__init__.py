"""Plans: the fluent frame and whole workloads."""

from .frame import Frame, MergeSource, purge, switch

__all__ = ["Frame", "MergeSource", "purge", "switch"]
