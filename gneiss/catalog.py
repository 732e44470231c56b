"""All registered queries: importing this module registers them."""

from __future__ import annotations

from gneiss.plans import analysis, configured, corpus, dependencies, examples, files, linkage, projections, proofs, retrieval, scalars, steps  # noqa: F401
from gneiss.registry import CHOICES, ORACLES, QUERIES  # noqa: F401
