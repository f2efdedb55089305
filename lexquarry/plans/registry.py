"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from lexquarry.functions.text import white_sql
from lexquarry.plans import assembly, chunking, cleaning, corpus, layout, parsing, retrieval, stores

_PARTS = (retrieval, corpus, cleaning, chunking, layout, assembly, parsing, stores)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: white_sql(sql) for part in _PARTS for name, sql in part.SQL.items()}
