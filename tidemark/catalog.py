"""All queries over the relational tables, and the SQL that gives the same rows."""

from .plans import market_queries, record_queries, research, research_sql, stream_queries, table_queries, trading_queries

QUERIES: dict = {**research.QUERIES, **trading_queries.QUERIES, **record_queries.QUERIES, **market_queries.QUERIES, **stream_queries.QUERIES, **table_queries.QUERIES}
ORACLE_SQL: dict = {**research_sql.ORACLE_SQL, **trading_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **market_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL, **table_queries.ORACLE_SQL}
