"""All queries over the test tables, gathered from the operator modules."""

from .operators import arcs, measures, mining, params, reports  # noqa: F401
from .registry import ORACLE, QUERIES
from .operators import registered as registered_operators  # noqa: F401
from .operators import registered_discovery  # noqa: F401
from .sources import registered  # noqa: F401
from .streaming import registered as registered_streams  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
