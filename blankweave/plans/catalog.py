"""All registered queries: importing the modules fills the registry."""

from __future__ import annotations

from blankweave.plans import (  # noqa: F401
    batch_queries,
    block_queries,
    cell_queries,
    edit_queries,
    merge_queries,
    stream_queries,
    table_queries,
    text_queries,
)
from blankweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
