"""The queries of this subpackage and their SQL."""

from . import licences, mixing, pages, pieces, pseudonyms, quality, search, secrets, simhash, tokens

MODULES = (mixing, pseudonyms, search, quality, simhash, tokens, secrets, licences, pages, pieces)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
