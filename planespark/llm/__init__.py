"""Training-data operators: dedup, tokenizers, classifiers, archives, packing.

Nothing outside this subpackage imports it. ``registry.queries()`` and
``registry.oracle_sql()`` are what ``__spark_entry__`` adds to its own.
"""
