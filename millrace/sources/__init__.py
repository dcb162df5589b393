"""Sources: delimited text, tokens, fixed-width sort-benchmark records, generators, Parquet."""

from .files import read_csv, read_parquet, read_records, read_tokens
from .generator import generate

__all__ = ["generate", "read_csv", "read_parquet", "read_records", "read_tokens"]
