"""The registered queries of the library."""

from brindle.plans.base import registry
from brindle.plans import changes, documents, entities, governance, graphs, ingest, relational, search, streams  # noqa: F401

__all__ = ["registry"]
