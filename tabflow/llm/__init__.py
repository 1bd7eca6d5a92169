"""Operators of a training-data pipeline: deduplication, packing, token counts, sharding,
encoding, language-model scores, archives, vector search and toxicity.

Nothing else in the library imports this subpackage.  ``suite.py`` lists its queries.
"""
