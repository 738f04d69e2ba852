"""Importing this module registers every query."""

from tickweave.plans import bar_queries, report_queries, robustness_queries, signal_queries, stream_queries, structure_queries, trade_queries, zone_queries  # noqa: F401
from tickweave.plans.catalogue import ORACLES, QUERIES  # noqa: F401
