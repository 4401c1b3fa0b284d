"""Training-data operators: extraction, tokens, shards, dedup, quality, PII, decontamination, packing.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries only when it can be imported.
"""
