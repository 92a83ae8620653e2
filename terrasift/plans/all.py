"""All registered queries: importing this module fills the registry."""

from . import cell_queries, extra_queries, gate_queries, network_queries, place_queries, surface_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
