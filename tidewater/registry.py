"""Queries and equivalent SQL of the general operators, gathered from the modules below."""

from __future__ import annotations

from tidewater.functions import strings
from tidewater.operators import aggregates, graphs, learning, relational, sequences
from tidewater.sources import files
from tidewater.streaming import changes

MODULES = [files, relational, aggregates, sequences, strings, graphs, learning, changes]

QUERIES = {k: f for m in MODULES for k, f in m.book.queries.items()}
ORACLES = {k: s for m in MODULES for k, s in m.book.oracles.items()}
