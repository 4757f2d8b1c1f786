"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage. Import the modules
directly (``from evigraph.llm import packing``); the registered queries and
their SQL are in ``evigraph.llm.queries``.
"""
