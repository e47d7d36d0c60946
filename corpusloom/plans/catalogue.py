"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from corpusloom.plans import derived, files, folds, monitoring, records, retrieval, services, text

QUERIES = {**retrieval.QUERIES, **text.QUERIES, **monitoring.QUERIES, **records.QUERIES, **derived.QUERIES, **services.QUERIES, **folds.QUERIES, **files.QUERIES}
ORACLES = {**retrieval.ORACLES, **text.ORACLES, **monitoring.ORACLES, **records.ORACLES, **derived.ORACLES, **services.ORACLES, **folds.ORACLES, **files.ORACLES}
