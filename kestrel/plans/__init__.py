"""Named queries: importing this package registers all of them."""

from . import basket_queries, core_queries, influence_queries, message_queries, model_queries, stats_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
