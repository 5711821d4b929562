"""All named queries."""

from .core_queries import catalog as core
from .lane_queries import catalog as lanes
from .more_queries import catalog as more

CATALOGS = (core, lanes, more)
