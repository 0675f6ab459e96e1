"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import catalogues, gains, levels, scripts, spectra, streams, texts

_MODULES = (scripts, texts, levels, gains, spectra, catalogues, streams)
QUERIES = {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
