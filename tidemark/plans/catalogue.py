"""All registered queries; importing this module registers them."""

from tidemark.plans import chain, completions, finance, live, search, sensors, wearables, wells  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401
