"""Every operator as a named query over the given tables, with its SQL where there is one."""

from rankloom.catalog import (
    judging, learning, losing, mining, predicting, ranking, retrieving, shaping, texts,
)
from rankloom.catalog.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
