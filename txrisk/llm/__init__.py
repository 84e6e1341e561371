"""Training-data operators: filters, de-duplication, search, sharding, mixing and packing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
