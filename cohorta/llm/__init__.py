"""Training-data operators: filters, scoring, deduplication, packing.

Nothing outside this subpackage imports it; the driver entry adds its
queries when it is present.
"""
