"""Training-data operators: sharding, dedup, scoring, packing, decontamination and formatting.

Nothing outside this subpackage imports it.
"""
