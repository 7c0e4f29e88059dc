"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from terrace.llm import (
    fingerprints,
    fmindex,
    language,
    packing,
    pii,
    quality,
    simhash,
    sstable,
    tokencount,
    urlfilter,
)

_MODULES = (fingerprints, urlfilter, packing, pii, simhash, language, quality, tokencount, fmindex, sstable)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
