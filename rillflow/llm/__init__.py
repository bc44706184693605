"""Training-data operators: tokenizing, deduplication, filtering, linking and packing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
