"""All registered plans."""

from evigraph.plans import relational, retrieval, scalar, streams  # noqa: F401
from evigraph.plans.registry import PLANS, SQL, runner

__all__ = ["PLANS", "SQL", "runner"]
