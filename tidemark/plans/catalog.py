"""All registered queries; importing this module fills the registry."""

from tidemark.plans import evals, feed, governance, research, storage, streams, style  # noqa: F401
from tidemark.plans.registry import ORACLE, PLANS

__all__ = ["ORACLE", "PLANS"]
