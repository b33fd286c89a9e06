"""All registered queries of the core; importing the modules registers them."""

from parvis.plans import aggregate, geo, names, resolve, search, text  # noqa: F401
from parvis.plans.registry import ORACLES, QUERIES  # noqa: F401
