"""Imports every query module so that the registry is complete."""

from hearthmark.plans import (  # noqa: F401
    q_history,
    q_lifecycle,
    q_market,
    q_places,
    q_pricepaid,
    q_search,
    q_stream,
    q_text,
    q_trade,
    q_valuation,
)
from hearthmark.plans.registry import ORACLES, QUERIES  # noqa: F401
