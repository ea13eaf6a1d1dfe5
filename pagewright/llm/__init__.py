"""Training-data operators: packing, deduplication, filtering, mixing, scoring and binary outputs.

Nothing outside this subpackage imports it, so it can be removed without touching the rest of the library.
"""
