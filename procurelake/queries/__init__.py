"""The registered queries: the engine's operators over the star-schema tables, and the same in SQL for DuckDB.

There are no tenders in those tables, so they are mapped by shape: ``events`` are health checks and crawl
jobs, their users the sources; ``orders`` are tenders with closing dates computed from the key; customers
and nations are organisations and provinces; ``documents`` are document texts; ``pages`` are crawled pages.
Times that the engine takes as ``as_of`` are fixed here.
"""

from procurelake.queries import documents, health, search, tenders

QUERIES = {**health.QUERIES, **tenders.QUERIES, **search.QUERIES, **documents.QUERIES}
ORACLE_SQL = {**health.ORACLE_SQL, **tenders.ORACLE_SQL, **search.ORACLE_SQL, **documents.ORACLE_SQL}
