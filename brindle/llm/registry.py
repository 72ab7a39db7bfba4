"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from brindle.llm import queries as q
from brindle.llm import sql

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}
ORACLES = {name: text for name, text in vars(sql).items() if name.startswith("op")}
