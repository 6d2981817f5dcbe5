"""crivo - data-quality, key-discovery and reconciliation reports on Spark DataFrames."""

from . import functions, labels, operators, plans, sources
from .spec import TableSpec, role_of

__version__ = "0.1.0"
__all__ = ["TableSpec", "functions", "labels", "operators", "plans", "role_of", "sources"]
