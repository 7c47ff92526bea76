"""Operators for preparing training data: deduplication, tokens, classifiers, mixing and sharding.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its queries when it is present.
"""
