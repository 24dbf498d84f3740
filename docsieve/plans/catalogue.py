"""The registered queries and their SQL."""

from docsieve.plans import addresses, audit, documents, identities, issuers, memos, minors, persons, quality, registrations, reviews

_MODULES = [documents, memos, registrations, audit, quality, reviews, persons, addresses, identities, minors, issuers]
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
