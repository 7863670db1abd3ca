"""All queries of this package by name, with the SQL of those that SQL can express."""

from sparkcurate.llm import (decontamination, licenses, lm_scoring, mixing, packing, periodic, pii, prefix_trie, quality,
                             secrets, sharding, simhash, toxicity)

MODULES = (simhash, mixing, sharding, toxicity, decontamination, quality, secrets, pii,
           licenses, lm_scoring, packing, periodic, prefix_trie)

QUERIES = {name: build for module in MODULES for name, build in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
