"""All registered queries and the SQL they must match."""

from plumbline.workloads import (  # noqa: F401
    cleaning,
    compliance,
    functions,
    graph,
    history,
    inference,
    profiles,
    rules,
    sources,
    streams,
)
from plumbline.workloads.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
