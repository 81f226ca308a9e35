"""Operators for large training-data pipelines: deduplication, decontamination,
packing, token counting, language identification and web archives.

Nothing else in the package imports this subpackage.
"""
