"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from quarry.plans import library_plans, more, retrieval, wider

ENTRIES = {**retrieval.ENTRIES, **library_plans.ENTRIES, **more.ENTRIES, **wider.ENTRIES}
QUERIES = {name: f for name, (f, _) in ENTRIES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
