"""Operators for large-scale training-data pipelines (dedup, search, quality,
language, tokens, toxicity, mixing).  Nothing else in the library imports this
subpackage."""
