"""The queries of this repository over the test tables, each with its SQL counterpart where one exists."""

from . import aggregates, fitting, least_squares, scoring, sources_and_cells  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
