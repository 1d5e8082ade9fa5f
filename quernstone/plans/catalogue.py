"""Every query of the retrieval and repair operators, by name, with its SQL where SQL can express it."""

from quernstone.plans import jobs, records, retrieval, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (retrieval, texts, records, jobs):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
