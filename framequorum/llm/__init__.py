"""Training-data operators: language, safety, dedup, sharding, tokenising and mixing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
