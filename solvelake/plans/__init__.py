"""Named queries over the test tables, each beside the ANSI SQL it must equal."""

from solvelake.plans import access, catalog, core, leaderboard, live, maintain, payloads, quality, scores, text  # noqa: F401
from solvelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
