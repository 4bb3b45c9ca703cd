"""Operators for large-scale training-data pipelines (language id, archives, dedup, mixing, tokenising).

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it is present.
"""
