"""All queries over the tables of a folder, with the SQL that states the same result."""

from __future__ import annotations

from . import cells, documents, files, text

QUERIES = {**text.QUERIES, **cells.QUERIES, **documents.QUERIES, **files.QUERIES}
ORACLES = {**text.ORACLES, **cells.ORACLES, **documents.ORACLES, **files.ORACLES}
