"""All registered queries and their SQL twins."""

from __future__ import annotations

from plover.queries import ingesting, problems, problems_sql, searching, streams

FLAGSHIP = "search_top"
QUERIES = {**problems.QUERIES, **searching.QUERIES, **ingesting.QUERIES, **streams.QUERIES}
SQL: dict[str, str] = {**problems_sql.SQL, **searching.SQL, **ingesting.SQL, **streams.SQL}
