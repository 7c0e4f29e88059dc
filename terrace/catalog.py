"""All queries of the library, each with the DuckDB SQL that gives the same rows where there is one."""

from terrace.queries import aggregates, extras, joins, more, reshape, scalars, streams, texts, windows

_MODULES = (aggregates, joins, windows, reshape, scalars, more, texts, extras, streams)

FLAGSHIP = "pricing_summary"
QUERIES = {name: f for m in _MODULES for name, f in m.BOOK.queries.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.BOOK.oracles.items()}
