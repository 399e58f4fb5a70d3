"""All queries of the library by name, with the SQL that gives the same rows."""

from . import detect, features, finance, search, text, usage

MODULES = (finance, text, search, detect, usage, features)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
