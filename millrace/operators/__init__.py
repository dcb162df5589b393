"""Operators on DataFrames: merges of several inputs, and partitioning."""

from .merge import Merge, MergePattern, concatenate, join, semi_join
from .partitioning import hash_partition, key_partition, order_by, range_bounds, range_partition, remap_partition

__all__ = [
    "Merge", "MergePattern", "concatenate", "hash_partition", "join", "key_partition",
    "order_by", "range_bounds", "range_partition", "remap_partition", "semi_join",
]
