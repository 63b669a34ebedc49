"""All named queries."""

from trackloom.plans import alignment, integrity, modelling, profiling, rasters, scoring, sequences  # noqa: F401
from trackloom.plans.registry import ORACLES, QUERIES  # noqa: F401
