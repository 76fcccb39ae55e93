"""Runnable queries over a data folder, each beside the SQL an independent engine answers it with."""

from flagstone.catalog.registry import ENTRIES, load_all

__all__ = ["ENTRIES", "load_all"]
