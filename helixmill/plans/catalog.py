"""All queries of the plan modules."""

from helixmill.plans import batching, collate, corpus, evaluate, geometry, jobs, models, relational, tokens  # noqa: F401
from helixmill.plans.registry import COVERS, ORACLE, QUERIES  # noqa: F401
