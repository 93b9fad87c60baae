"""The queries of this subpackage and their SQL."""

from . import bpe, jaccard, lm, media, mixing, secrets, sharding, substrings, topk, toxicity

MODULES = (substrings, jaccard, secrets, bpe, mixing, lm, sharding, toxicity, media, topk)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
