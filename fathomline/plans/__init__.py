"""Named queries over the tables, and SQL with the same results."""

from . import corpus, kernels, operators, panel, series
from .views import oracle, query

TEXTS = {name: (text, text) for name, text in series.SQL.items()}
TEXTS |= {name: (module.sql(name, False), module.sql(name, True)) for module in (panel, corpus) for name in module.SQL}

QUERIES = {name: query(text[0]) for name, text in TEXTS.items()} | kernels.QUERIES | operators.QUERIES
ORACLES = {name: oracle(text[1]) for name, text in TEXTS.items()} | {name: oracle(text) for name, text in kernels.ORACLES.items()} | operators.ORACLES
