"""Training-data operators: deduplication, filters, mixing, packing.

Nothing else in the package imports this subpackage; the registry adds its
queries only when it can be imported.
"""
