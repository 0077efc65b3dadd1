"""Training-data operators: filters, near-duplicates, mixing and tokenisation.

Nothing outside this subpackage imports it.  ``queries`` and ``oracles`` are
collected from the modules by ``monthmill.llm.registry``.
"""
