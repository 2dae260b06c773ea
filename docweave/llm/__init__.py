"""Operators of a training-data pipeline: sharding, deduplication, tokens, quality, language.

Nothing else in ``docweave`` imports this subpackage.  Every operator is one
module; ``queries`` binds them to the given tables.
"""
