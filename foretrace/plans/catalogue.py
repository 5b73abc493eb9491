"""All registered queries."""

from foretrace.plans import boards, checks, evaluation, frame, models, records, streams, windows  # noqa: F401
from foretrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
