"""Operators for large-scale training-data pipelines (URL filters to packing); nothing else in the library imports this."""
