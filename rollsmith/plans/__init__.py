"""All queries of the engine's own operators, with their SQL."""

from rollsmith.plans import advantage, batches, extensions, mathematics, metrics, misc, records, selection, texts, tokens, windows  # noqa: F401
from rollsmith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
